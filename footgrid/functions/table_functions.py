"""Walks and labels as table functions, to be called from SQL.

A call names the partitions, so Spark spreads the work::

    SELECT * FROM walk_tiles(TABLE(SELECT tr, tc, r, c, target, open FROM tiles) PARTITION BY (tr, tc), 8.0, 256)

``tiled`` makes such a table: each cell once for every tile whose halo of a walk's steps it lies in. A partition is one tile with its
halo, whatever the grid's size. Cells without a walk within the bound give no row; a partition without a target gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from footgrid.operators.components import local_labels
from footgrid.operators.tiles import TILE, with_tiles
from footgrid.operators.walk import FAR, ROOT2, relaxed, steps_within


def tiled(cells: DataFrame, target: Column, open_: Column, bound_m: float, block_m: float, tile: int = TILE) -> DataFrame:
    """tr, tc, r, c, target, open: the table that ``walk_tiles`` reads."""
    marked = cells.select("r", "c", target.alias("target"), open_.alias("open"))
    return with_tiles(marked, steps_within(bound_m, block_m), tile).select("tr", "tc", "r", "c", "target", "open")


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


class _Collected:
    """A partition's rows, which come as slices of Arrow batches."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []

    def arrays(self, *names: str) -> list[np.ndarray]:
        rows = pa.Table.from_batches(self.batches)
        return [rows[k].to_numpy() for k in names]


@arrow_udtf(returnType="r int, c int, n_orth int, n_diag int, length double")
class WalkTiles(_Collected):
    """Shortest walks, in blocks, from the targets of a tile and its halo to its own cells."""

    def eval(self, rows: pa.RecordBatch, bound: pa.Array, tile: pa.Array):
        if not self.batches:
            self.at, self.bound, self.tile = (rows["tr"][0].as_py(), rows["tc"][0].as_py()), float(bound[0].as_py()), tile[0].as_py()
        self.batches.append(rows)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if not self.batches:
            return
        r, c, target, open_ = self.arrays("r", "c", "target", "open")
        # A grid may be narrower than a tile: only the box about the rows is walked.
        r_min, c_min = r.min(), c.min()
        start, walkable = (np.zeros((np.ptp(r) + 1, np.ptp(c) + 1), bool) for _ in range(2))
        start[r - r_min, c - c_min], walkable[r - r_min, c - c_min] = target.astype(bool), open_.astype(bool)
        r0, c0 = (max(0, k * self.tile - low) for k, low in zip(self.at, (r_min, c_min)))
        r1, c1 = (max(0, (k + 1) * self.tile - low) for k, low in zip(self.at, (r_min, c_min)))
        if not start.any() or not start[r0:r1, c0:c1].size:
            return
        s, d = (x[r0:r1, c0:c1] for x in relaxed(start, walkable, self.bound))
        i, j = np.nonzero(s < FAR)
        s, d = s[i, j], d[i, j]
        yield _batch(r=(i + r0 + r_min).astype(np.int32), c=(j + c0 + c_min).astype(np.int32), n_orth=s, n_diag=d, length=s + d * ROOT2)


@arrow_udtf(returnType="r int, c int, first_r int, first_c int")
class LabelTiles(_Collected):
    """The first cell, in row-major order, of each cell's component within its partition; by eight directions, or four if ``queen`` is false."""

    def eval(self, rows: pa.RecordBatch, queen: pa.Array):
        self.queen = queen[0].as_py()
        self.batches.append(rows)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if not self.batches:
            return
        r, c = self.arrays("r", "c")
        r_min, c_min = r.min(), c.min()
        mask = np.zeros((np.ptp(r) + 1, np.ptp(c) + 1), bool)
        mask[r - r_min, c - c_min] = True
        first = local_labels(mask, self.queen)
        i, j = np.nonzero(mask)
        found = {"r": i + r_min, "c": j + c_min, "first_r": first[i, j] // mask.shape[1] + r_min, "first_c": first[i, j] % mask.shape[1] + c_min}
        yield _batch(**{k: v.astype(np.int32) for k, v in found.items()})


def registered(spark: SparkSession) -> None:
    """Makes ``walk_tiles`` and ``label_tiles`` known to the session's SQL."""
    spark.udtf.register("walk_tiles", WalkTiles)
    spark.udtf.register("label_tiles", LabelTiles)
