"""Part of terrafold; see the README for the map of modules."""
