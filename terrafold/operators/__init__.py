"""Operators of the spatial library."""
