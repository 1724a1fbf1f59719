"""Connected components of cells: tiles label their own cells, then the labels that meet
at tile borders are joined. Rounds depend on how many tiles a component winds through
(their logarithm), not on its length in cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from footgrid.functions.codes import QUEEN, ROOK, ring
from footgrid.functions.storage import kept, kept_and_seen
from footgrid.operators.tiles import TILE, framed, grid_of, on_tiles, own_rows

SHIFT = 32
#: A component of fewer cells is seen whole within as many steps of each of its cells, so a halo tells it; for more, components are labelled.
MOST_SEEN = 64


def local_labels(mask: np.ndarray, queen: bool) -> np.ndarray:
    """Smallest place (row-major) of each cell's component; -1 outside."""
    n = mask.size
    place = np.where(mask, np.arange(n).reshape(mask.shape), n)
    rows, cols = mask.shape
    while True:
        new = place.copy()
        for dr, dc in QUEEN if queen else ROOK:
            to = (slice(max(0, dr), rows + min(0, dr)), slice(max(0, dc), cols + min(0, dc)))
            of = (slice(max(0, -dr), rows + min(0, -dr)), slice(max(0, -dc), cols + min(0, -dc)))
            new[to] = np.minimum(new[to], place[of])
        new[~mask] = n
        new = np.append(new.ravel(), n)[new]
        if (new == place).all():
            return np.where(mask, place, -1)
        place = new


def _starred(edges: DataFrame, keys: Sequence[str], large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours and itself to the smallest of them all."""
    k = list(keys)
    turned = edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.union(turned) if large else edges.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(*k, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, [*k, "a"])
    out = linked.where("b > a" if large else "true").select(*k, F.col("b").alias("a"), F.col("m").alias("b"))
    return (out if large else out.union(least.select(*k, "a", F.col("m").alias("b")))).where("a <> b").distinct()


def joined_labels(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, root for all nodes on edges (a, b): alternating stars until nothing changes."""
    metrics = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "a", "b")).alias("mix")]
    edges, seen = kept_and_seen(edges.where("a <> b").distinct(), *metrics, name="edges")
    before = None
    while seen["n"] and seen != before:
        before = seen
        edges, seen = kept_and_seen(_starred(_starred(edges, keys, True), keys, False), *metrics, name="edges")
    return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))


def components(cells: DataFrame, queen: bool = True, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, root of the given cells: ``root`` is the component's first cell in row-major order, as r * 2**32 + c."""
    k = list(keys)

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        rows = rows.assign(one=True)
        label = local_labels(grid_of(rows, r0, c0, "one", 0, False, bool, tile), queen)
        r, c = np.nonzero(label >= 0)
        first = label[r, c]
        return pd.DataFrame({"r": r + r0, "c": c + c0, "root": (first // tile + r0 << SHIFT) + first % tile + c0})

    own = cells.select(*k, "r", "c")
    named = "".join(f"{x} {own.schema[x].dataType.simpleString()}, " for x in k)
    local = kept(on_tiles(own, work, named + "r int, c int, root long", 0, k, tile), "labels")
    border = local.where((F.col("r") % tile == 0) | (F.col("r") % tile == tile - 1) | (F.col("c") % tile == 0) | (F.col("c") % tile == tile - 1))
    around = border.select(*k, "r", "c", "root", F.explode(ring(queen)).alias("x")).select(*k, (F.col("r") + F.col("x.dr")).alias("r"), (F.col("c") + F.col("x.dc")).alias("c"), F.col("root").alias("a"))
    edges = around.join(border.withColumnRenamed("root", "b"), [*k, "r", "c"]).where("a <> b").select(*k, "a", "b")
    renamed = joined_labels(edges, k).select(*k, F.col("node").alias("root"), F.col("root").alias("_root"))
    return local.join(renamed, [*k, "root"], "left").select(*k, "r", "c", F.coalesce("_root", "root").alias("root"))


def numbered(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``label``: 1, 2, ... in the order of the roots, within each key. Ranks are found within
    ranges of roots and shifted by the counts of the ranges before."""
    k = list(keys)
    roots = labels.select(*k, "root").distinct()
    ranges = kept(roots.repartitionByRange(*k, "root").withColumn("part", F.spark_partition_id()), "roots")
    counts = ranges.groupBy(*k, "part").count().withColumn("before", F.sum("count").over(W.partitionBy(*k).orderBy("part")) - F.col("count"))
    own = ranges.withColumn("rank", F.row_number().over(W.partitionBy(*k, "part").orderBy("root")))
    ranked = own.join(counts, [*k, "part"]).select(*k, "root", (F.col("rank") + F.col("before")).cast("int").alias("label"))
    return labels.join(ranked, [*k, "root"]).select(*k, "r", "c", "root", "label")


def sizes(mask: np.ndarray, queen: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's component within one array (-1 outside) and the cells of each."""
    label = local_labels(mask, queen)
    return label, np.bincount(label[mask], minlength=mask.size)


def large(mask: np.ndarray, least: int, queen: bool) -> np.ndarray:
    """The cells in components of at least ``least`` cells; right where ``least`` cells or more from the array's edge."""
    label, size = sizes(mask, queen)
    return mask & (size[label] >= least)


def large_components(cells: DataFrame, least: int, queen: bool = False, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c of the cells in components of at least ``least`` cells."""
    if least <= MOST_SEEN:
        own = cells.select(*keys, "r", "c")

        def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
            mine = own_rows(rows, r0, c0, tile)
            if not mine.any():
                return rows.loc[mine, ["r", "c"]]
            r, c, shape = framed(rows)
            mask, at = np.zeros(shape, bool), (rows["r"].to_numpy() - r, rows["c"].to_numpy() - c)
            mask[at] = True
            return rows.loc[mine & large(mask, least, queen)[at], ["r", "c"]]

        named = "".join(f"{x} {own.schema[x].dataType.simpleString()}, " for x in keys)
        return on_tiles(own, work, named + "r int, c int", least, keys, tile)
    labels = components(cells, queen, keys, tile)
    big = labels.groupBy(*keys, "root").count().where(F.col("count") >= least).select(*keys, "root")
    return labels.join(big, [*keys, "root"], "left_semi").select(*keys, "r", "c")
