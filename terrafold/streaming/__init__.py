"""Streaming of the spatial library."""
