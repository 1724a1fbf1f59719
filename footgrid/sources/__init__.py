"""Readers: driver tables as grids, vector layers, tagged map features, elevation."""
