"""Sources of the spatial library."""
