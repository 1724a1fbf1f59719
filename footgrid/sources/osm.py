"""Tagged map features from XML files: nodes, ways, relations, and their geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_TAGS = "tag array<struct<_k string, _v string>>"


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, lon, lat, tags of every node."""
    rows = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _lon double, _lat double, {_TAGS}").load(path)
    return rows.select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _map("tag").alias("tags"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, refs, tags of every way."""
    rows = spark.read.format("xml").option("rowTag", "way").schema(f"_id string, nd array<struct<_ref string>>, {_TAGS}").load(path)
    return rows.select(F.col("_id").alias("way_id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<string>")).alias("refs"), _map("tag").alias("tags"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    """rel_id, outers (way ids), tags of multipolygon relations."""
    rows = spark.read.format("xml").option("rowTag", "relation").schema(f"_id string, member array<struct<_type string, _ref string, _role string>>, {_TAGS}").load(path)
    outer = F.filter("member", lambda m: (m["_type"] == "way") & F.coalesce(m["_role"], F.lit("")).isin("outer", ""))
    out = rows.select(F.col("_id").alias("rel_id"), F.transform(outer, lambda m: m["_ref"]).alias("outers"), _map("tag").alias("tags"))
    return out.where(F.try_element_at("tags", F.lit("type")) == "multipolygon")


def _map(column: str) -> Column:
    entries = F.transform(F.coalesce(F.col(column), F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    return F.map_from_entries(F.array_distinct(entries))


def looks_valid(body: Column) -> Column:
    """Whether a response is map data and carries no run-time error."""
    head = F.lower(F.substring(body, 1, 1024)).contains("<osm")
    return head & ~body.rlike(r"(?is)<remark>[^<]*(?:runtime error|timed out|timeout)")


def way_coordinates(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, points (lon, lat in order) of the ways with two known nodes or more; unknown ones are left out."""
    spread = ways.select("way_id", F.posexplode("refs").alias("pos", "id"))
    known = spread.join(nodes.select("id", "lon", "lat"), "id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    return known.where(F.size("p") >= 2).select("way_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))


def is_closed(points: Column) -> Column:
    """Whether points make a ring: the first is the last, and there are four or more."""
    return (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))


def stitched(pieces: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from line pieces, joined end to end in either direction; what doesn't close is dropped."""
    left, rings = [list(p) for p in pieces if len(p) > 1], []
    while left:
        ring = left.pop(0)
        grew = True
        while ring[0] != ring[-1] and grew:
            grew = False
            for i, p in enumerate(left):
                for q in (p, p[::-1]):
                    if q[0] == ring[-1]:
                        ring += q[1:]
                    elif q[-1] == ring[0]:
                        ring[:0] = q[:-1]
                    else:
                        continue
                    del left[i]
                    grew = True
                    break
                if grew:
                    break
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def relation_rings(relations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """rel_id, rings (arrays of x, y) of relations' outer ways; a relation's ways are one group."""
    pieces = relations.select("rel_id", F.posexplode("outers").alias("pos", "way_id")).join(coordinates, "way_id")

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        lines = [[(p["lon"], p["lat"]) for p in x] for x in rows.sort_values("pos")["points"]]
        return pd.DataFrame({"rel_id": [key[0]], "rings": [[[{"x": a, "y": b} for a, b in ring] for ring in stitched(lines)]]})

    return pieces.groupBy("rel_id").applyInPandas(work, "rel_id string, rings array<array<struct<x:double,y:double>>>").where(F.size("rings") > 0)
