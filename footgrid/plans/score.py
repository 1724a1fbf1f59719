"""Scores of plans: coverage, cost, provision, compactness, audits of centres.

Each is one aggregate over the plan's cells joined to walking distances; a group key (an ensemble's member)
rides along as just more rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from footgrid.functions.codes import BUILT_CODES, CENTRE_CODES
from footgrid.functions.storage import kept
from footgrid.operators.components import MOST_SEEN, large, large_components
from footgrid.operators.neighbours import neighbours
from footgrid.operators.tiles import TILE, framed, on_tiles, own_rows
from footgrid.operators.walk import FAR, ROOT2, relaxed, served_by_area, steps_within, walk_field
from footgrid.plans.classify import centre_areas


def distances(plan: DataFrame, block_m: float, centre_m: float, green_m: float, span_m: float, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, plan, park, centre_dist, green_dist: walks to a centre and to a park large enough, over all cells but those of code 0.

    Where a large enough park is of few cells, a tile with a halo of a walk and of as many cells tells its parks and walks both ways, so that
    cells are shuffled once and never joined."""
    k = list(keys)
    bound = max(centre_m, green_m)
    least = max(1, round((span_m / block_m) ** 2))
    if least <= MOST_SEEN:
        reach, limit = steps_within(bound, block_m), bound / block_m
        own = plan.select(*k, "r", "c", "plan")

        def work(rows: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
            mine = own_rows(rows, r0, c0, tile)
            if not mine.any():
                return rows.loc[mine, ["r", "c", "plan"]].assign(park=False, centre_dist=0.0, green_dist=0.0)
            r, c, shape = framed(rows)
            codes, at = np.zeros(shape, np.int64), (rows["r"].to_numpy() - r, rows["c"].to_numpy() - c)
            codes[at] = rows["plan"]
            park = large(codes == 1, least, False)
            at = (at[0][mine], at[1][mine])
            out = rows.loc[mine, ["r", "c", "plan"]].assign(park=park[at])
            for name, start in (("centre_dist", np.isin(codes, CENTRE_CODES)), ("green_dist", park)):
                s, d = (x[at] for x in relaxed(start, codes != 0, limit))
                out[name] = np.where(s < FAR, float(block_m) * (s + d * ROOT2), np.nan)
            return out

        named = "".join(f"{x} {own.schema[x].dataType.simpleString()}, " for x in k)
        found = on_tiles(own, work, named + "r int, c int, plan int, park boolean, centre_dist double, green_dist double", reach + least, k, tile)
        return found.select(*k, "r", "c", "plan", "park", *[F.nullif(F.col(x), F.lit(float("nan"))).alias(x) for x in ("centre_dist", "green_dist")])
    parks = large_components(plan.where("plan = 1"), least, False, k, tile).withColumn("park", F.lit(True))
    marked = kept(plan.join(parks, [*k, "r", "c"], "left").select(*k, "r", "c", "plan", F.coalesce("park", F.lit(False)).alias("park")), "parks")
    field = lambda target, name: walk_field(marked, target, F.col("plan") == 0, bound, block_m, k, tile).select(*k, "r", "c", F.col("dist").alias(name))
    to_centre, to_green = field(F.col("plan").isin(*CENTRE_CODES), "centre_dist"), field(F.col("park"), "green_dist")
    return marked.join(to_centre, [*k, "r", "c"], "left").join(to_green, [*k, "r", "c"], "left").select(*k, "r", "c", "plan", "park", "centre_dist", "green_dist")


def coverage(dist: DataFrame, centre_m: float, green_m: float, keys: Sequence[str] = ()) -> DataFrame:
    """A row of shares, costs and means for each key; a home out of reach costs twice the threshold."""
    c, g = F.coalesce(F.col("centre_dist") <= centre_m, F.lit(False)), F.coalesce(F.col("green_dist") <= green_m, F.lit(False))
    homes = dist.where(F.col("plan").isin(*BUILT_CODES)).withColumn("c_near", c).withColumn("g_near", g)
    share = lambda x: F.avg(x.cast("double"))
    c_cost = F.avg(F.when(F.col("c_near"), F.col("centre_dist")).otherwise(2.0 * centre_m))
    g_cost = F.avg(F.when(F.col("g_near"), F.col("green_dist")).otherwise(2.0 * green_m))
    both = F.col("c_near") & F.col("g_near")
    out = homes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("built_cells"), share(F.col("c_near")).alias("centre_coverage"), share(F.col("g_near")).alias("green_coverage"), share(both).alias("served_coverage"), share(~both).alias("unserved_fraction"),
        c_cost.alias("centre_access"), g_cost.alias("green_access"), F.avg(F.when(F.col("c_near"), F.col("centre_dist"))).alias("centre_walk_mean"), F.avg(F.when(F.col("g_near"), F.col("green_dist"))).alias("green_walk_mean"),
    )
    out = out.withColumn("access_cost", 0.5 * (F.col("centre_access") + F.col("green_access")))
    return out.select(*keys, "built_cells", *[F.round(x, 4).alias(x) for x in out.columns if x not in (*keys, "built_cells")])


def compactness(plan: DataFrame) -> DataFrame:
    """Share of built cells' four sides that touch another built cell."""
    built = plan.where(F.col("plan").isin(*BUILT_CODES)).select("r", "c")
    pairs = neighbours(built, queen=False).agg(F.count(F.lit(1)).alias("sides"))
    n = built.agg(F.count(F.lit(1)).alias("built_cells"))
    return n.crossJoin(pairs).select("built_cells", F.round(F.coalesce(F.try_divide(F.col("sides"), 4 * F.col("built_cells")), F.lit(0.0)), 6).alias("compactness"))


def provision(plan: DataFrame, block_m: float, density_km2: float) -> DataFrame:
    """New residents, and square metres of new centre and of new green (fixed green not counted) for each."""
    p, area = F.col("plan"), block_m * block_m
    count = lambda x: F.sum(x.cast("long"))
    sums = plan.agg(count(p.isin(2, 3)).alias("new"), count(p == 3).alias("centre"), count((p == 1) & (F.col("origin") != 0)).alias("green"))
    people = F.col("new") * density_km2 * area / 1e6
    each = lambda x: F.round(F.coalesce(F.try_divide(F.col(x) * area, people), F.lit(0.0)), 4)
    return sums.select(F.round(people, 4).alias("population"), each("centre").alias("centre_m2_per_person"), each("green").alias("green_m2_per_person"))


def efficiency(dist: DataFrame, centre_m: float, green_m: float) -> DataFrame:
    """Homes near a centre for each centre cell, and near a park for each park cell."""
    home = F.col("plan").isin(*BUILT_CODES)
    count = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    sums = dist.agg(count(home & (F.col("centre_dist") <= centre_m)).alias("a"), count(F.col("plan").isin(*CENTRE_CODES)).alias("b"), count(home & (F.col("green_dist") <= green_m)).alias("d"), count(F.col("park")).alias("e"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0)), 4)
    return sums.select(ratio("a", "b").alias("centre_efficiency"), ratio("d", "e").alias("green_efficiency"))


def transit(plan: DataFrame, stops: DataFrame, block_m: float, bound_m: float, threshold_m: float) -> DataFrame:
    """Share of homes within the threshold of a stop, and their mean walk to it."""
    marked = plan.join(stops.select("r", "c").withColumn("stop", F.lit(True)), ["r", "c"], "left").select("r", "c", "plan", F.coalesce("stop", F.lit(False)).alias("stop"))
    field = walk_field(marked, F.col("stop"), F.col("plan") == 0, bound_m, block_m)
    homes = marked.where(F.col("plan").isin(*BUILT_CODES)).join(field.select("r", "c", "dist"), ["r", "c"], "left")
    near = F.coalesce(F.col("dist") <= threshold_m, F.lit(False))
    return homes.agg(F.round(F.avg(near.cast("double")), 4).alias("transit_coverage"), F.round(F.avg(F.when(near, F.col("dist"))), 4).alias("transit_walk_mean"))


def centre_audit(plan: DataFrame, block_m: float, bound_m: float) -> DataFrame:
    """A row for each centre area: its mean place (rounded half to even), cells, homes within the walk, their mean walk, whether it is old."""
    areas = kept(centre_areas(plan).join(plan.select("r", "c", "plan"), ["r", "c"]), "areas")
    about = areas.groupBy("root").agg(F.bround(F.avg("r")).cast("int").alias("row"), F.bround(F.avg("c")).cast("int").alias("col"), F.count(F.lit(1)).alias("cells"), F.max((F.col("plan") == 5)).alias("old"))
    cells = plan.select("r", "c", "plan").join(areas.select("r", "c", "root"), ["r", "c"], "left")
    found = served_by_area(cells, F.col("root"), F.col("plan").isin(*BUILT_CODES), F.col("plan") == 0, bound_m, block_m)
    walks = F.lit(float(block_m)) * (F.col("n_orth") + F.col("n_diag") * F.lit(ROOT2))
    served = found.select(F.col("area").alias("root"), "served", F.when(F.col("served") > 0, F.round(walks / F.col("served"), 4)).alias("mean_dist"))
    return about.join(served, "root", "left").select("root", "row", "col", "cells", F.coalesce("served", F.lit(0)).cast("long").alias("served"), "mean_dist", "old")


def audit_summary(audit: DataFrame) -> DataFrame:
    """Numbers of areas, the least, middle and most homes served, the same for new ones, the middle of the mean walks."""
    new = F.when(~F.col("old"), F.col("served"))
    whole = lambda x: F.floor(F.median(x)).cast("long")
    return audit.agg(
        F.count(F.lit(1)).alias("n"), F.count(new).alias("n_new"), F.min("served").alias("served_min"), whole(F.col("served")).alias("served_median"), F.max("served").alias("served_max"),
        F.min(new).alias("new_min"), whole(new).alias("new_median"), F.max(new).alias("new_max"), F.round(F.median("mean_dist"), 4).alias("walk_median"),
    )


def weakest(audit: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` new areas that serve fewest homes."""
    return audit.where("NOT old").orderBy("served", "root").limit(n).select("row", "col", "cells", "served", "mean_dist")
