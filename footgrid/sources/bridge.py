"""Grids derived from the driver's relational tables, by integer arithmetic only.

A grid has a hundred columns and a row for every hundred orders. Blocks are 100 m wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = 100
BLOCK_M = 100
#: Persons a block in the three density tiers.
HIGH, MEDIUM, LOW = 60.0, 30.0, 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_rows(spark: SparkSession, sf_dir: str) -> int:
    """Grid rows; a count that Parquet's footers answer."""
    return table(spark, sf_dir, "orders").count() // COLUMNS


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, state, origin, density of every cell."""
    r, c = F.expr("o_orderkey div 100").cast("int"), (F.col("o_orderkey") % 100).cast("int")
    block = ((F.expr("r div 8") * 131 + F.expr("c div 8") * 71) % 7) < 3
    state = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), -1).when(block & (F.col("o_orderpriority") != "1-URGENT"), 1).otherwise(0)
    origin = F.when((F.col("state") == 1) & (F.col("o_custkey") % 3 == 0), 1).when((F.col("state") == 0) & (F.col("o_custkey") % 11 == 0), 0).otherwise(-1)
    price = F.col("o_totalprice")
    density = F.when((F.col("state") == 1) & (F.col("origin") == -1), F.when(price > 300000, HIGH).when(price > 150000, MEDIUM).otherwise(LOW)).otherwise(0.0)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
    grid = orders.select(r.alias("r"), c.alias("c"), "*").withColumn("state", state.cast("int")).withColumn("origin", origin.cast("int"))
    return grid.select("r", "c", "state", "origin", density.cast("double").alias("density"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, r, c of centre seeds; those of even ord exist already."""
    rows = n_rows(spark, sf_dir)
    key = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(key.alias("ord"), (key * 7919 % rows).cast("int").alias("r"), (key * 104729 % COLUMNS).cast("int").alias("c"))


def stops(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """Cells with a stop."""
    rows = n_rows(spark, sf_dir)
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select((F.col("event_id") * 31 % rows).cast("int").alias("r"), ((F.col("user_id") * 17 + F.col("event_id")) % COLUMNS).cast("int").alias("c")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, r, c, state, origin of an ensemble: the cells' states, but for those that a member's line items set.

    A cell's line items become one number, five bits a member, of which the lowest one set tells the least flag: so cells and line items
    are shuffled once, not once a member."""
    flag = F.col("l_returnflag")
    kind = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).otherwise(4)
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber BETWEEN 1 AND 7")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (5 * (F.col("l_linenumber").cast("int") - 1) + kind).cast("int"))
    flags = lines.select(F.expr("l_orderkey div 100").cast("int").alias("r"), (F.col("l_orderkey") % 100).cast("int").alias("c"), bit.alias("bit")).groupBy("r", "c").agg(F.bit_or("bit").alias("flags"))
    every = cells(spark, sf_dir).select("r", "c", "state", "origin").join(flags, ["r", "c"], "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("member"))
    own = F.call_function("shiftright", F.coalesce("flags", F.lit(0).cast("long")), 5 * (F.col("member") - 1)).bitwiseAND(F.lit(31))
    state = F.when((F.col("state") == -1) | (own == 0), F.col("state")).when(own.bitwiseAND(-own) == 2, 0).when(own.bitwiseAND(-own) == 8, 1).otherwise(2)
    return every.select("member", "r", "c", state.cast("int").alias("state"), "origin")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-parallel rectangles in metres: pid, x0, y0, x1, y1 (y grows upwards)."""
    height = n_rows(spark, sf_dir) * BLOCK_M
    p = table(spark, sf_dir, "part")
    x0, y0 = F.col("p_partkey") * 37 % 9000, F.col("p_partkey") * 53 % (height - 600)
    return p.select(F.col("p_partkey").alias("pid"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 20 * F.col("p_size") + 7).cast("double").alias("x1"), (y0 + 11 * F.col("p_size") + 3).cast("double").alias("y1"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, state, origin, density with seeds set as centres (on buildable cells)."""
    placed = seeds(spark, sf_dir).groupBy("r", "c").agg(F.min("ord").alias("ord"))
    grid = cells(spark, sf_dir).join(placed, ["r", "c"], "left")
    centre = F.col("ord").isNotNull() & (F.col("state") != -1)
    return grid.select("r", "c", F.when(centre, 2).otherwise(F.col("state")).alias("state"), "origin", "density", F.when(centre, F.col("ord") % 2 == 0).otherwise(False).alias("old_centre"))
