"""Readers and writers for rasters, vectors, archives and listings."""
