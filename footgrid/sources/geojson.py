"""Vector layers as feature rows, and feature rows as layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

POINT, LINE, POLYGON, MULTI = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


#: What ends a piece of a collection that is read by ranges: the mark of a feature.
_MARK = '"Feature"'


def _parsed(rows: DataFrame) -> DataFrame:
    """dataset, fid, geom_type, rings, props of features ``f`` (a struct)."""
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda a: F.transform(a, xy)
    rings = (
        F.when(kind == "Point", F.array(F.array(xy(F.from_json(text, POINT))))).when(kind == "LineString", F.array(line(F.from_json(text, LINE))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(F.from_json(text, POLYGON), line))
        .when(kind == "MultiPolygon", F.flatten(F.transform(F.from_json(text, MULTI), lambda p: F.transform(p, line))))
    )
    out = rows.select("dataset", "fid", kind.alias("geom_type"), rings.alias("rings"), F.col("f.properties").alias("props"))
    return out.where(F.size("rings") > 0)


FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _named(found: DataFrame) -> Column:
    return F.col("dataset").cast("string") if "dataset" in found.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def features(spark: SparkSession, path: str) -> DataFrame:
    """dataset (the file's name, or the folder's as ``write_collections`` writes it), fid, geom_type, rings (arrays of x, y), props of every feature of the
    FeatureCollections at ``path`` (a file, folder or pattern). Features without coordinates are skipped; no features is no rows. A task
    reads a whole file, whatever the order of its keys; ``feature_ranges`` reads large ones."""
    found = spark.read.text(path, wholetext=True)
    body = found.select("value", _named(found).alias("dataset"))
    return _parsed(body.select("dataset", F.posexplode(F.from_json("value", f"struct<features:array<{FEATURE}>>")["features"]).alias("fid", "f")))


def feature_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The same of large collections: Spark's text reader splits a file by bytes, so that many tasks read one.

    A piece goes from one feature's mark to the next one's, whatever the blanks and line breaks; a feature's ``type`` comes before its properties and geometry,
    as writers put it, and the mark is no value of anything else: a piece that is no feature then is an error, not a lost row. ``fid`` counts a file's features: those of the
    ranges before, and the place within its own range."""
    found = spark.read.option("lineSep", _MARK).text(path)
    pieces = found.select("value", _named(found).alias("dataset"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    # The first piece of a file is what comes before its features.
    counts = pieces.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)))
    placed = pieces.join(before, ["file", "start"]).withColumn("fid", (F.col("row") - F.col("first") + F.coalesce("before", F.lit(0)) - 1).cast("int")).where("fid >= 0")
    # The head of the next feature, or the collection's end, is cut off; what is left is closed as an object.
    body = F.regexp_replace("value", r"[\s,]*\{[^{}\[\]]*\"type\"\s*:\s*$", "")
    f = F.from_json(F.concat(F.lit('{"type":"Feature"'), body), FEATURE, {"mode": "PERMISSIVE"})
    bad = f["geometry"].isNull() & ~F.col("value").rlike(r"\"geometry\"\s*:\s*null")
    checked = F.when((F.col("fid") >= 0) & bad, F.raise_error(F.concat(F.lit("no feature: "), F.col("file"), F.lit(" "), F.left("value", F.lit(80))))).otherwise(f)
    return _parsed(placed.select("dataset", "fid", checked.alias("f")))


def extents(spark: SparkSession, folder: str) -> DataFrame:
    """The features of every ``extents*.geojson`` of a folder, with ``extent``: the rest of the file's name, ``main`` where there is none."""
    found = features(spark, f"{folder.rstrip('/')}/extents*.geojson")
    rest = F.regexp_replace(F.replace(F.col("dataset"), F.lit("extents"), F.lit("")), "^_+|_+$", "")
    return found.withColumn("extent", F.when(rest == "", "main").otherwise(rest))


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the files that an archive of a scenario takes: caches (``_*``) and personal projects (``*.qgz``) stay out."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size")).where(~name.startswith("_") & ~name.endswith(".qgz"))


def snapped(rows: DataFrame, grid: int = 1) -> DataFrame:
    """Coordinates rounded to ``grid`` decimals; features that collapse (polygons to no area, lines to one place) are dropped."""
    from footgrid.operators.geometry import line_length, ring_area

    at = lambda p: F.struct(F.round(p["x"], grid).alias("x"), F.round(p["y"], grid).alias("y"))
    out = rows.withColumn("rings", F.transform("rings", lambda r: F.transform(r, at)))
    area = F.abs(ring_area(F.get("rings", 0)))
    return out.where(F.when(F.col("geom_type") == "Polygon", area > 0).when(F.col("geom_type") == "LineString", line_length(F.get("rings", 0)) > 0).otherwise(F.size("rings") > 0))


def as_lines(rows: DataFrame) -> DataFrame:
    """dataset, fid, value: a JSON feature for each point, line or polygon, coordinates snapped to 0.1; others raise."""
    place = lambda p: F.array(p["x"], p["y"])
    rings = F.transform("rings", lambda r: F.transform(r, place))
    kind = F.col("geom_type")
    coordinates = F.when(kind == "Point", F.to_json(rings[0][0])).when(kind == "LineString", F.to_json(rings[0])).when(kind == "Polygon", F.to_json(rings)).otherwise(F.raise_error(F.concat(F.lit("split first: "), kind)))
    value = F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce(F.to_json("props"), F.lit("{}")), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return snapped(rows).select("dataset", "fid", value.alias("value"))


def write_collections(rows: DataFrame, path: str, metadata: dict[str, str], per_file: int = 50_000) -> None:
    """FeatureCollections with their metadata, a folder for each dataset and files of about ``per_file`` features each, so that no
    task holds a whole dataset. ``features`` reads them back."""
    import json

    numbered = as_lines(rows)
    sizes = numbered.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / per_file).alias("parts"))  # a row for each dataset
    dealt = numbered.join(sizes, "dataset").withColumn("part", F.pmod(F.xxhash64("fid"), F.col("parts")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fid", "value"))), lambda x: x["value"]), ",")
    body = F.concat(F.lit('{"type":"FeatureCollection","metadata":' + json.dumps(metadata, separators=(",", ":")) + ',"features":['), listed, F.lit("]}"))
    dealt.groupBy("dataset", "part").agg(body.alias("value")).select("dataset", "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("dataset").text(path)
