"""Neighbourhoods, rings and disks by equi-joins on shifted keys; spans and window sums on tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from footgrid.functions.codes import ring
from footgrid.operators.tiles import TILE, grid_of, on_tiles


def neighbours(cells: DataFrame, queen: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each cell with each neighbour in the grid: r, c, columns to ``keep``, slot ``i``, the neighbour's columns with ``n_`` before them."""
    around = cells.select("r", "c", *keep, F.explode(ring(queen)).alias("x")).select("r", "c", *keep, "x.i", (F.col("r") + F.col("x.dr")).alias("n_r"), (F.col("c") + F.col("x.dc")).alias("n_c"))
    others = cells.select(*[F.col(k).alias(f"n_{k}") for k in cells.columns])
    # Sizes are judged by the files' bytes, before rows are made of them: without a hint either side may be sent through the driver whole.
    return around.hint("merge").join(others, ["n_r", "n_c"])


def neighbour_counts(cells: DataFrame, member: Column) -> DataFrame:
    """r, c, rook_n, queen_n: neighbours for which ``member`` (a condition on columns ``n_*``) holds."""
    near = neighbours(cells).where(member)
    rook = (F.col("n_r") == F.col("r")) | (F.col("n_c") == F.col("c"))
    counts = near.groupBy("r", "c").agg(F.sum(rook.cast("long")).alias("rook_n"), F.count(F.lit(1)).alias("queen_n"))
    return cells.select("r", "c").join(counts, ["r", "c"], "left").select("r", "c", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("rook_n", "queen_n")])


def runs(flags: Column) -> tuple[Column, Column, Column]:
    """Of an array of 0/1 flags around a cell: how many are set, the longest run, how many
    runs. The first and last run are one if the ring has all eight slots and there are two or more."""
    text = F.array_join(flags, "")
    pieces = F.filter(F.split(text, "0"), lambda x: F.length(x) > 0)
    wrap = (F.size(flags) == 8) & (F.size(pieces) > 1) & text.startswith("1") & text.endswith("1")
    lengths = F.transform(pieces, lambda x: F.length(x))
    ends = F.when(wrap, F.element_at(lengths, 1) + F.element_at(lengths, -1)).otherwise(0)
    total = F.length(F.regexp_replace(text, "0", ""))
    longest = F.when(total == 0, 0).otherwise(F.greatest(F.array_max(lengths), ends))
    return total, longest, F.size(pieces) - wrap.cast("int")


def ring_runs(cells: DataFrame, member: Column) -> DataFrame:
    """r, c, total, longest, runs of ring slots whose neighbour is a ``member``; slots outside the grid are left out."""
    slots = neighbours(cells).groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("i", member.cast("int").alias("set")))).alias("slots"))
    total, longest, n = runs(F.transform("slots", lambda s: s["set"].cast("string")))
    return slots.select("r", "c", total.alias("total"), longest.alias("longest"), n.alias("runs"))


def _carried(cells: DataFrame, line: str, along: str, back: str, on: str, tile: int) -> DataFrame:
    """``cells`` with ``_back`` and ``_on``: the nearest stop (at, state) before and after each along its line, and the line's ends there.

    A segmented scan: stops are looked up within a tile's stretch of the line; what a stretch doesn't hold is carried over from the
    stretches before and after it, of which a line has one row each."""
    stop = F.when(F.col("state") != 0, F.struct(F.col(along).alias("at"), F.col("state").alias("state")))
    dealt = cells.withColumn("_t", F.floor(F.col(along) / tile).cast("int"))
    rows = W.partitionBy(line, "_t").orderBy(along)
    near = dealt.withColumn("_b", F.last(stop, True).over(rows.rowsBetween(W.unboundedPreceding, -1))).withColumn("_a", F.first(stop, True).over(rows.rowsBetween(1, W.unboundedFollowing)))
    at = F.when(F.col("state") != 0, F.col(along))
    parts = dealt.groupBy(line, "_t").agg(F.max_by(stop, at).alias("last"), F.min_by(stop, at).alias("first"), F.min(along).alias("low"), F.max(along).alias("high"))
    order = W.partitionBy(line).orderBy("_t")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy(line)
    carry = parts.select(line, "_t", F.last("last", True).over(before).alias("_cb"), F.first("first", True).over(after).alias("_ca"), F.min("low").over(whole).alias("_low"), F.max("high").over(whole).alias("_high"))
    both = near.join(carry, [line, "_t"])
    span = lambda own, over, edge: F.coalesce(F.abs(F.col(along) - F.coalesce(own, over)["at"]) - 1, F.abs(F.col(along) - F.col(edge))).cast("int")
    ends = [F.coalesce(a, b)["state"].alias(f"{n}_end") for n, a, b in ((back, F.col("_b"), F.col("_cb")), (on, F.col("_a"), F.col("_ca")))]
    return both.select(*cells.columns, span(F.col("_b"), F.col("_cb"), "_low").alias(back), span(F.col("_a"), F.col("_ca"), "_high").alias(on), *ends)


def green_spans(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs of green from each cell to the nearest other state in the four directions: ``left``,
    ``right``, ``up``, ``down`` (the cell itself not counted) and what ends each (null: the grid's edge)."""
    across = _carried(cells.select("r", "c", "state"), "r", "c", "left", "right", tile)
    names = ("left", "right", "up", "down")
    return _carried(across, "c", "r", "up", "down", tile).select("r", "c", "state", *names, *[f"{k}_end" for k in names])


def span_admissible(spans: DataFrame, least_cells: float) -> DataFrame:
    """r, c, ok: no span between 0 and ``least_cells`` that ends at anything but unbuildable land; the edge blocks too."""
    bad = lambda k: (F.col(k) > 0) & (F.col(k) < least_cells) & ~F.coalesce(F.col(f"{k}_end") == -1, F.lit(False))
    return spans.select("r", "c", (~(bad("left") | bad("right") | bad("up") | bad("down"))).alias("ok"))


def box_sum(cells: DataFrame, value: Column, radius: int, tile: int = TILE) -> DataFrame:
    """r, c, s: sum over the (2 radius + 1)-wide square, clamped at the edges; tiles with a halo of the radius, by running sums."""
    width = 2 * radius + 1

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        values = np.pad(grid_of(rows, r0, c0, "v", radius, 0, np.int64, tile), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        sums = values[width:, width:] - values[:-width, width:] - values[width:, :-width] + values[:-width, :-width]
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        own = (r >= r0) & (r < r0 + tile) & (c >= c0) & (c < c0 + tile)
        r, c = r[own], c[own]
        return pd.DataFrame({"r": r, "c": c, "s": sums[r - r0, c - c0]})

    return on_tiles(cells.select("r", "c", F.coalesce(value, F.lit(0)).cast("long").alias("v")), work, "r int, c int, s long", radius, (), tile)


def disk(radius: int) -> Column:
    """Array of steps within a Euclidean radius."""
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])


def disk_cover(sources: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """r, c, n: sources within the radius, for cells that have any."""
    spread = sources.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.explode(disk(radius)).alias("x"))
    covered = spread.groupBy((F.col("sr") + F.col("x.dr")).alias("r"), (F.col("sc") + F.col("x.dc")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("r", "c").join(covered, ["r", "c"])
