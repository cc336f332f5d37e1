"""Spark-first analytics for survey data: clouds, rasters, matches, tracks and captures."""
