"""Elevation from tiles of one degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the tile that holds a place, after its south-west corner."""
    y, x = F.floor(lat), F.floor(lon)
    part = lambda v, pos, neg, width: F.concat(F.when(v >= 0, pos).otherwise(neg), F.lpad(F.abs(v).cast("string"), width, "0"), F.lit("_00"))
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), part(y, "N", "S", 2), F.lit("_"), part(x, "E", "W", 3), F.lit("_DEM"))


def heights(cells: DataFrame, elevation: DataFrame) -> DataFrame:
    """r, c, h of cells (tile, row, col in it); where a tile or a value is missing, the height is 0."""
    found = cells.join(elevation.select("tile", "row", "col", "h"), ["tile", "row", "col"], "left")
    return found.select("r", "c", F.coalesce("h", F.lit(0.0)).alias("h"))


def unbuildable_bands(bands: DataFrame, max_degrees: float) -> DataFrame:
    """Stretches of the bands at least as steep as the limit, which are not built on."""
    return bands.where(F.col("band") >= max_degrees)
