"""Readers and writers: text tables here, binary point files and grids beside."""
