"""Square tiles with a halo, so that bounded neighbourhood work needs one shuffle and no rounds.

A walk of at most ``halo`` steps never leaves the halo of the tile it ends in, so a
tile with its halo has all that its own cells' results depend on. A task holds
one tile, whose size is a parameter; the grid may have any number of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TILE = 256


def with_tiles(cells: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Each cell once for every tile whose halo it lies in: columns ``tr``, ``tc``."""
    span = lambda k: F.sequence(F.floor((F.col(k) - halo) / tile), F.floor((F.col(k) + halo) / tile))
    return cells.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c")))


def on_tiles(cells: DataFrame, work: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str, halo: int, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """``work(rows, r0, c0)`` for every tile and key; ``schema`` names its result's columns (with the keys first).

    A tile's work is out of proportion to its bytes, so the session's number of shuffle partitions is kept, not merged by bytes."""
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        *own, tr, tc = key
        out = work(rows, int(tr) * tile, int(tc) * tile)
        for k, v in zip(reversed(keys), reversed(own)):
            out.insert(0, k, v)
        return out

    return with_tiles(cells, halo, tile).repartition(n, *keys, "tr", "tc").groupBy(*keys, "tr", "tc").applyInPandas(run, schema)


def grid_of(rows: pd.DataFrame, r0: int, c0: int, column: str, halo: int, fill, dtype, tile: int = TILE) -> np.ndarray:
    """A column as an array over the tile and its halo; ``fill`` where there is no cell."""
    out = np.full((tile + 2 * halo, tile + 2 * halo), fill, dtype=dtype)
    out[rows["r"].to_numpy() - r0 + halo, rows["c"].to_numpy() - c0 + halo] = rows[column].to_numpy()
    return out


def framed(rows: pd.DataFrame) -> tuple[int, int, tuple[int, int]]:
    """First row, first column and shape of the box about a tile's rows; a grid may be narrower than a tile."""
    r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
    return int(r.min()), int(c.min()), (int(np.ptp(r)) + 1, int(np.ptp(c)) + 1)


def own_rows(rows: pd.DataFrame, r0: int, c0: int, tile: int = TILE) -> np.ndarray:
    """Which rows are a tile's own, not its halo's."""
    r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
    return (r >= r0) & (r < r0 + tile) & (c >= c0) & (c < c0 + tile)
