"""Composites, and the queries over the star-schema tables."""
