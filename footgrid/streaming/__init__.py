"""Growth frames as a stream: counts that follow a run while its steps are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STEP_SCHEMA = "member int, step int, written_at timestamp, r int, c int, state int, density double"


def step_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Cells of steps as they arrive in a folder, one Parquet file or more for each step."""
    return spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def progress(steps: DataFrame, target: float, late: str = "10 minutes") -> DataFrame:
    """member, step and its built cells, centres, residents and share of the target; a step is final once the watermark has passed it."""
    sums = steps.withWatermark("written_at", late).groupBy(F.window("written_at", "1 minute"), "member", "step")
    counts = sums.agg(F.sum((F.col("state") == 1).cast("long")).alias("built"), F.sum((F.col("state") == 2).cast("long")).alias("centres"), F.sum("density").alias("population"))
    return counts.select("member", "step", "built", "centres", "population", (F.col("population") / target).alias("ratio"))
