"""From states to plans, and clean-up of plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footgrid.functions.codes import BUILT_CODES, CENTRE_CODES
from footgrid.operators.components import MOST_SEEN, components, large, large_components, sizes
from footgrid.operators.tiles import TILE, framed, on_tiles, own_rows


def _schema(cells: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{x} {cells.schema[x].dataType.simpleString()}" for x in columns)


def state_to_plan(states: DataFrame, block_m: float, span_m: float, keys: Sequence[str] = (), also: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, plan from state and origin, and the columns ``also``: unbuildable land is none; fixed green and green in rook
    components of enough cells are green, other green none; urban cells are built.

    Where components of enough cells are small, tiles with a halo of as many cells tell them and nothing is joined."""
    least = max(1, round((span_m / block_m) ** 2))
    code = F.when(F.col("state") == -1, 0).when((F.col("origin") == 0) | F.col("park"), 1).when(F.col("state") > 0, 2).otherwise(0)
    if least > MOST_SEEN:
        parks = large_components(states.where("state = 0"), least, False, keys, tile).withColumn("park", F.lit(True))
        return states.join(parks, [*keys, "r", "c"], "left").select(*keys, "r", "c", code.cast("int").alias("plan"), *also)
    carried = [x for x in dict.fromkeys(("state", "origin", *also))]
    own = states.select(*keys, "r", "c", *carried)

    def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        mine = own_rows(rows, r0, c0, tile)
        if not mine.any():
            return rows.loc[mine, ["r", "c", *carried]].assign(park=False)
        r, c, shape = framed(rows)
        mask, at = np.zeros(shape, bool), (rows["r"].to_numpy() - r, rows["c"].to_numpy() - c)
        mask[at] = rows["state"].to_numpy() == 0
        return rows.loc[mine, ["r", "c", *carried]].assign(park=large(mask, least, False)[at][mine])

    found = on_tiles(own, work, _schema(own, [*keys, "r", "c", *carried]) + ", park boolean", least, keys, tile)
    return found.select(*keys, "r", "c", code.cast("int").alias("plan"), *also)


def marked_existing(plan: DataFrame, centre: Column, old_centre: Column, old_built: Column) -> DataFrame:
    """``plan`` with centres set (3, old ones 5) and old fabric told apart (4)."""
    p = F.col("plan")
    urban = p.isin(*BUILT_CODES)
    code = F.when(urban & centre & old_centre, 5).when(urban & centre, 3).when((p == 2) & old_built, 4).otherwise(p)
    return plan.withColumn("plan", code.cast("int"))


def existing_fabric(cells: DataFrame, seed: Column) -> DataFrame:
    """r, c, plan of what was there before: fixed green, old built land, old centres; unbuildable land is none."""
    code = F.when(F.col("state") == -1, 0).when(seed, 5).when(F.col("origin") == 0, 1).when(F.col("origin") == 1, 4).otherwise(0)
    return cells.select("r", "c", code.cast("int").alias("plan"))


def stage_codes(cells: DataFrame) -> DataFrame:
    """r, c, code of a growth panel: old fabric as it is marked, else the bare state."""
    code = F.when(F.col("origin") == 1, 7).when(F.col("origin") == 0, 8).when(F.col("origin") == 2, 9).when(F.col("state") == -1, 255).otherwise(F.col("state"))
    return cells.select("r", "c", code.cast("int").alias("code"))


def shown_likelihood(surfaces: DataFrame, least: float = 0.04) -> DataFrame:
    """r, c, opacity of the cells likely enough to be drawn."""
    return surfaces.where(F.col("p_built") > least).select("r", "c", F.round(0.30 + 0.70 * F.col("p_built"), 6).alias("opacity"))


def pruned(plan: DataFrame, least: int, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Settlements (queen components of urban cells) of fewer than ``max(least, 4)`` cells that hold nothing old become green.

    So small a settlement lies within a halo of as many cells; where that would be wide, settlements are labelled and joined."""
    k, least = list(keys), max(least, 4)
    if least <= MOST_SEEN:
        others = [x for x in plan.columns if x not in (*k, "r", "c")]
        own = plan.select(*k, "r", "c", *others)

        def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
            mine = own_rows(rows, r0, c0, tile)
            if not mine.any():
                return rows.loc[mine, ["r", "c", *others]].assign(gone=False)
            r, c, shape = framed(rows)
            mask, old, at, code = np.zeros(shape, bool), np.zeros(shape, bool), (rows["r"].to_numpy() - r, rows["c"].to_numpy() - c), rows["plan"]
            mask[at], old[at] = code.isin(BUILT_CODES), code.isin((4, 5))
            label, size = sizes(mask, True)
            held = np.bincount(label[old], minlength=mask.size)
            gone = mask & (size[label] < least) & (held[label] == 0)
            return rows.loc[mine, ["r", "c", *others]].assign(gone=gone[at][mine])

        found = on_tiles(own, work, _schema(own, own.columns) + ", gone boolean", least, k, tile)
        return found.withColumn("plan", F.when(F.col("gone"), 1).otherwise(F.col("plan")).cast("int")).select(*plan.columns)
    labels = components(plan.where(F.col("plan").isin(*BUILT_CODES)), True, k, tile)
    urban = plan.join(labels, [*k, "r", "c"])
    small = urban.groupBy(*k, "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("plan").isin(4, 5)).alias("old")).where((F.col("n") < least) & ~F.col("old")).select(*k, "root")
    gone = labels.join(small, [*k, "root"], "left_semi").select(*k, "r", "c", F.lit(True).alias("gone"))
    return plan.join(gone, [*k, "r", "c"], "left").withColumn("plan", F.when(F.col("gone"), 1).otherwise(F.col("plan")).cast("int")).drop("gone")


def absorbed(plan: DataFrame, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Clusters of new built cells of fewer than ``max(least, 4)`` cells inside a settlement that holds something old become old fabric."""
    k = list(keys)
    settled = components(plan.where(F.col("plan").isin(*BUILT_CODES)), True, k)
    old = plan.where("plan IN (4, 5)").join(settled, [*k, "r", "c"]).select(*k, "root").distinct()
    inside = settled.join(old, [*k, "root"], "left_semi").select(*k, "r", "c")
    clusters = components(plan.where("plan IN (2, 3)"), True, k)
    small = clusters.groupBy(*k, "root").count().where(F.col("count") < max(least, 4)).select(*k, "root")
    gone = clusters.join(small, [*k, "root"], "left_semi").join(inside, [*k, "r", "c"], "left_semi").select(*k, "r", "c", F.lit(True).alias("gone"))
    return plan.join(gone, [*k, "r", "c"], "left").withColumn("plan", F.when(F.col("gone"), 4).otherwise(F.col("plan")).cast("int")).drop("gone")


def centre_areas(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, r, c, root of centre cells: queen components of centres."""
    return components(plan.where(F.col("plan").isin(*CENTRE_CODES)), True, keys)


def raw_plan(states: DataFrame, block_m: float, span_m: float) -> DataFrame:
    """r, c, plan of a member as it grew (r, c, state, origin), before any clean-up: its own centres shown, old fabric marked."""
    coded = state_to_plan(states, block_m, span_m, also=("state", "origin"))
    shown = coded.withColumn("plan", F.when(F.col("state") == 2, 3).otherwise(F.col("plan")))
    return marked_existing(shown, F.lit(False), F.lit(False), F.col("origin") == 1).select("r", "c", "plan")


def drawn_per_km2(density: Column, block_m: float) -> Column:
    """Persons a square kilometre from persons a block."""
    return density / (block_m * block_m / 1e6)
