"""Walkable-growth analytics on square grids, as Spark jobs."""
