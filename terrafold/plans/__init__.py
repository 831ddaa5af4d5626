"""Plans of the spatial library."""
