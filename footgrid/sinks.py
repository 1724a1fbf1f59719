"""Writers: rasters as partitioned tables, feature layers, parameter files, reports, galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footgrid.functions.params import BOOLEANS, DOUBLES, INTEGERS, MARKER, STRINGS

#: The metrics that a gallery entry shows.
GALLERY_METRICS = ("built_cells", "centre_coverage", "green_coverage", "served_coverage", "access_cost", "centre_walk_mean", "green_walk_mean")


def write_frames(frames: DataFrame, path: str, first_year: int) -> None:
    """Classes by step (scenario, step, r, c, cls), a folder for each step, with the year in which the step is valid."""
    year = lambda d: F.make_date(F.col("step") + first_year + d, F.lit(1), F.lit(1))
    dated = frames.withColumn("valid_from", year(0)).withColumn("valid_to", year(1))
    dated.hint("rebalance", F.col("scenario"), F.col("step")).sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("scenario", "step").parquet(path)


def write_bands(surfaces: DataFrame, path: str) -> None:
    """Likelihood bands (r, c, p_built, p_green) as single precision."""
    surfaces.select("r", "c", *[F.col(k).cast("float") for k in surfaces.columns if k not in ("r", "c")]).write.mode("overwrite").parquet(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan raster; cells of code 0 are no data and left out."""
    plan.where("plan <> 0").select("r", "c", F.col("plan").cast("tinyint")).write.mode("overwrite").parquet(path)


def write_layers(features: DataFrame, path: str) -> DataFrame:
    """Features, a folder for each dataset, written aside first and then put in place of the old ones; gives the number of each."""
    spark = features.sparkSession
    aside = f"{path.rstrip('/')}.new"
    # A dataset that is larger than a task should hold is split over several files.
    features.hint("rebalance", F.col("dataset")).write.mode("overwrite").partitionBy("dataset").parquet(aside)
    _replace(spark, aside, path)
    return spark.read.parquet(path).groupBy("dataset").count()


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Moves a finished folder over another, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(old)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{new} could not be moved to {old}")


def params_json(columns: list[str]) -> Column:
    """A parameter document of the known fields among ``columns``, the schema marker first."""
    known = [c for c in columns if c in (*DOUBLES, *INTEGERS, *BOOLEANS, *STRINGS)]
    return F.to_json(F.struct(F.lit(MARKER).alias("schema"), *known), {"pretty": "true"})


def write_params(rows: DataFrame, path: str) -> None:
    rows.select(params_json(rows.columns).alias("value")).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """line_no, line as one text file: a report is a page long (its lines are those of options and centres' summaries, not of cells)."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def gallery(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON entry for each row's seven metrics, to three decimals; missing ones are 0."""
    shown = [F.round(F.coalesce(F.col(m), F.lit(0.0)), 3).alias(m) if m in metrics.columns else F.lit(0.0).alias(m) for m in GALLERY_METRICS]
    return metrics.select(F.to_json(F.struct(*keys, F.struct(*shown).alias("metrics"))).alias("value"))
