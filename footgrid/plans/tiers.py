"""Density tiers: arranged by walking distance, shown, and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from footgrid.functions.storage import kept
from footgrid.operators.walk import FAR


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds 1, 2, ... in a total order: ranks within ranges of the order, shifted by the counts of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(W.orderBy("_part")) - F.col("count")
    counts = ranges.groupBy("_part").count().withColumn("_before", before).drop("count")  # a row for each range
    return ranges.join(F.broadcast(counts), "_part").withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")).drop("_part", "_before")


def arranged(dist: DataFrame, shares: tuple[float, float, float], densities: tuple[float, float, float]) -> DataFrame:
    """r, c, density of the new cells (plan 2, 3; with n_orth, n_diag of the walk to a centre, null if out of reach): the nearest get the
    highest density, by the shares of cells; ties by place."""
    new = dist.where("plan IN (2, 3)").withColumn("d", F.coalesce("centre_dist", F.lit(float(FAR))))
    total = new.agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(new.select("r", "c", F.round("d", 6).alias("d")), ["d", "r", "c"]).crossJoin(F.broadcast(total))  # one row
    high, medium = F.bround(shares[0] * F.col("n")), F.bround(shares[1] * F.col("n"))
    density = F.when(F.col("rank") <= high, densities[0]).when(F.col("rank") <= high + medium, densities[1]).otherwise(densities[2])
    return placed.select("r", "c", density.cast("double").alias("density"))


def tiered_plan(plan: DataFrame, density: DataFrame, tiers: tuple[float, float, float]) -> DataFrame:
    """r, c, code: new cells shown by the tier nearest to their density (built 6, 7, 8 and centre 9, 10, 11 for low, medium, high); ties go to low, then medium."""
    high, medium, low = (F.abs(F.col("density") - t) for t in tiers)
    tier = F.when((low <= medium) & (low <= high), 0).when(medium <= high, 1).otherwise(2)
    code = F.when(F.col("density").isNull(), F.col("plan")).when(F.col("plan") == 2, 6 + tier).when(F.col("plan") == 3, 9 + tier).otherwise(F.col("plan"))
    return plan.select("r", "c", "plan").join(density, ["r", "c"], "left").select("r", "c", code.cast("int").alias("code"))


def breakdown(coded: DataFrame, tiers: tuple[float, float, float], block_m: float) -> DataFrame:
    """tier, built_cells, centre_cells, population of each tier, and of all (``total``)."""
    tier = F.when(F.col("code").isin(6, 9), "low").when(F.col("code").isin(7, 10), "medium").otherwise("high")
    each = F.when(F.col("tier") == "high", tiers[0]).when(F.col("tier") == "medium", tiers[1]).otherwise(tiers[2]) * block_m * block_m / 1e6
    cells = coded.where("code >= 6").withColumn("tier", tier).withColumn("each", each)
    count = lambda x: F.sum(x.cast("long"))
    sums = cells.rollup("tier").agg(count(F.col("code") <= 8).alias("built_cells"), count(F.col("code") >= 9).alias("centre_cells"), F.round(F.sum("each"), 4).alias("population"))
    return sums.select(F.coalesce("tier", F.lit("total")).alias("tier"), "built_cells", "centre_cells", "population")
