"""Writers and the stream of steps."""

from __future__ import annotations

import datetime
import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from footgrid import sinks, streaming
from footgrid.functions import params, tags
from footgrid.operators import geometry, raster, walk
from footgrid.plans import report
from footgrid.sources import geojson


def test_frames_have_a_folder_and_a_year_for_each_step(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, 0, i, 1) for i in range(3)], "scenario string, step int, r int, c int, cls int")
    sinks.write_frames(rows, str(tmp_path / "f"), 2025)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert {(r.step, r.valid_from, r.valid_to) for r in back.collect()} == {(i, datetime.date(2025 + i, 1, 1), datetime.date(2026 + i, 1, 1)) for i in range(3)}
    assert (tmp_path / "f" / "scenario=s" / "step=2").is_dir()


def test_layers_are_replaced_when_they_are_complete(spark, tmp_path):
    path = str(tmp_path / "layers")
    for n in (3, 1):
        rows = spark.createDataFrame([("built" if i % 2 else "green", i) for i in range(n)], "dataset string, fid int")
        counts = {r.dataset: r["count"] for r in sinks.write_layers(rows, path).collect()}
    assert counts == {"green": 1}


def test_parameter_and_gallery_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 50.0, True, 1)], "name string, grid_size_m double, ensemble boolean, other int")
    doc = json.loads(rows.select(sinks.params_json(rows.columns)).first()[0])
    assert list(doc) == ["schema", "name", "grid_size_m", "ensemble"] and doc["grid_size_m"] == 50.0
    entry = json.loads(sinks.gallery(spark.createDataFrame([("p", 10, 0.12345, None)], "preset string, built_cells int, centre_coverage double, access_cost double"), ["preset"]).first().value)
    assert entry["metrics"]["centre_coverage"] == 0.123 and entry["metrics"]["access_cost"] == 0 and len(entry["metrics"]) == 7
    lines = spark.createDataFrame([(1, "b"), (0, "a")], "line_no int, line string")
    sinks.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_report_lines(spark):
    row = spark.createDataFrame([("x", "off", 10, 12000.0)], "name string, dispersal string, runs int, target double").withColumn("at", F.lit("2026-01-02 03:04:00").cast("timestamp"))
    assert [r.line for r in report.header_lines(row).orderBy("line_no").collect()] == ["Scenario: x", "Written: 2026-01-02 03:04", "Dispersal: No new settlements", "Runs: 10", "Target population: 12,000"]
    v = spark.range(1).select(report.percent(F.lit(0.825)), report.percent(F.lit(None).cast("double")), report.number(F.lit(1234.5)), report.share_of_target(F.lit(6085.0), 12000.0)).first()
    assert tuple(v) == ("82%", "-", "1,234", "6,085 (51% of target)")


def test_measures_of_features(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 40D, 'y', 0D), named_struct('x', 40D, 'y', 50D), named_struct('x', 0D, 'y', 50D), named_struct('x', 0D, 'y', 0D))"
    rows = spark.sql(f"SELECT 'Polygon' AS geom_type, array({ring}) AS rings UNION ALL SELECT 'LineString', array(slice({ring}, 1, 2)) UNION ALL SELECT 'Point', array(slice({ring}, 1, 1))")
    assert [r.geom_type for r in geometry.large_enough(rows).collect()] == ["Polygon", "Point"]
    # A place whose coordinates are published: the tower in Toronto, zone 17.
    p = spark.range(1).select(geometry.to_utm(F.lit(-79.387139), F.lit(43.642567)).alias("p"), geometry.utm_epsg(F.lit(-79.387139), F.lit(43.642567)).alias("e")).first()
    assert p.e == 32617 and abs(p.p.x - 630084) < 1 and abs(p.p.y - 4833438) < 1


def test_steps_are_counted_as_they_arrive(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    for step in range(2):
        spark.createDataFrame([(0, step, at, 0, c, 1 if c <= step else 0, 10.0 if c <= step else 0.0) for c in range(4)], streaming.STEP_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.progress(streaming.step_stream(spark, str(tmp_path / "in")), 40.0).writeStream.outputMode("update").format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.step, r.built, r.ratio) for r in spark.table("steps").collect()} == {(0, 1, 0.25), (1, 2, 0.5)}


SHAPES = (
    '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4.04,0],[4,4],[0,4],[0,0]]]}},'
    '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1.56,2.5]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[0,0],[0.01,0.02]]}}]}'
)


def test_collections_are_written_snapped_and_read_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("extents", "extents_north", "built"):
        (tmp_path / "in" / f"{name}.geojson").write_text(SHAPES)
    (tmp_path / "in" / "_cache.geojson").write_text("{}")
    (tmp_path / "in" / "own.qgz").write_text("")
    assert {(r.extent, r.geom_type) for r in geojson.extents(spark, str(tmp_path / "in")).collect()} == {(e, g) for e in ("main", "north") for g in ("Polygon", "Point", "LineString")}
    assert {r.path.rsplit("/", 1)[1] for r in geojson.archive_files(spark, str(tmp_path / "in")).collect()} == {"extents.geojson", "extents_north.geojson", "built.geojson"}
    geojson.write_collections(geojson.features(spark, str(tmp_path / "in" / "*.geojson")), str(tmp_path / "out"), {"crs": "EPSG:27700"}, per_file=1)
    back = geojson.features(spark, str(tmp_path / "out")).collect()
    # The line collapses; what is left keeps its dataset, names and places.
    assert sorted((r.dataset, r.geom_type) for r in back) == [(d, g) for d in ("built", "extents", "extents_north") for g in ("Point", "Polygon")]
    assert {(p.x, p.y) for r in back if r.geom_type == "Polygon" for p in r.rings[0]} == {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)}
    assert {json.loads(r.value)["metadata"]["crs"] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()} == {"EPSG:27700"}


def test_hulls_hold_all_points_and_turn_one_way(spark):
    rng = random.Random(3)
    points = [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(400)] + [(5.0, 5.0)] * 3 + [(None, 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    hull = [(r.x, r.y) for r in geometry.convex_hull(df.repartition(5)).orderBy("ord").collect()]
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    whole = set(points[:-1])
    # Brute force: a corner is a point that has all others on one side of a line to the next corner.
    for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2]):
        assert a in whole and cross(a, b, c) > 0 and all(cross(a, b, p) >= 0 for p in whole)
    wide = [(r.x, r.y) for r in geometry.buffered_hull(df, 10.0).orderBy("ord").collect()]
    assert all(9.9 < min(_to_segment(p, a, b) for a, b in zip(hull, hull[1:] + hull[:1])) < 10.0001 for p in wide)
    assert geometry.convex_hull(df.limit(0)).count() == 0
    assert [(r.x, r.y) for r in geometry.convex_hull(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")).collect()] == [(1.0, 2.0)]


def _to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_thinner_lines_stay_close(spark):
    rng = random.Random(5)
    line = [(i * 3.0, rng.uniform(-8, 8)) for i in range(200)]
    ring = [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    rows = spark.createDataFrame([("line", [line]), ("ring", [ring]), ("none", None)], "id string, rings array<array<struct<x:double,y:double>>>")
    thin = {r.id: r.rings and [(p.x, p.y) for p in r.rings[0]] for r in geometry.simplified(rows, 6.0).collect()}
    assert thin["none"] is None and thin["ring"][0] == thin["ring"][-1] and len(thin["ring"]) >= 4
    kept = thin["line"]
    assert kept[0] == line[0] and kept[-1] == line[-1] and len(kept) < 150
    assert all(min(_to_segment(p, a, b) for a, b in zip(kept, kept[1:])) <= 6.0 + 1e-9 for p in line)


def test_walks_stop_early_and_keep_to_straight_steps(spark):
    rng = random.Random(7)
    state = {(r, c): rng.choice((0, 0, 0, 1, -1)) for r in range(14) for c in range(14)}
    sources = [p for p in state if rng.random() < 0.1]
    cells = spark.createDataFrame([(r, c, s, (r, c) in sources) for (r, c), s in state.items()], "r int, c int, state int, seed boolean")
    for rook, stop in ((True, None), (False, 2), (True, 1)):
        want = set()
        for source in sources:
            found, best, heap = {source} if state[source] == 1 else set(), {source: 0.0}, [(0.0, source)]
            while heap:
                d, (r, c) = heapq.heappop(heap)
                if d > best[r, c]:
                    continue
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        p, step = (r + dr, c + dc), math.sqrt(2) if dr and dc else 1.0
                        if (dr, dc) == (0, 0) or (rook and dr and dc) or p not in state or d + step > 4 + 1e-9:
                            continue
                        if state[p] == 1:
                            found.add(p)
                        if state[p] == 0 and d + step < best.get(p, 99.0) - 1e-9:
                            best[p] = d + step
                            heapq.heappush(heap, (d + step, p))
                if stop and len(found) >= stop:
                    break
            want |= {(*source, *p) for p in found}
        got = walk.reach(cells, F.col("seed"), F.col("state") == 0, F.col("state") == 1, 400.0, 100.0, 5, rook, stop).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_small_rules(spark):
    assert params.next_folder("runs", set()) == "runs" and params.next_folder("runs", {"runs", "runs_2"}) == "runs_3"
    row = spark.range(1).select(report.option_record(F.lit("Grown"), F.lit("g"), F.create_map(F.lit("a"), F.lit(1.0)), F.lit(3)).alias("o"), params.run_name(F.lit(" a.tif ")).alias("n"), params.run_name(F.lit("a:b")).alias("bad")).first()
    assert row.o.label == "Grown" and row.o.n_centres == 3 and row.o.tiers is None and row.n == "a" and row.bad is None
    layers = spark.createDataFrame([("green", "g"), ("railways", "x"), ("extents", "e")], "dataset string, layer string")
    assert {(r.slot, r.layer) for r in tags.filled_slots(layers).collect()} == {("green", "g"), ("extents", "e")}


def test_each_area_serves_what_its_own_walk_reaches(spark):
    rng = random.Random(11)
    rows = [(r, c, rng.choice((0, 1, 1, 2)), 7 * (r // 6) + c // 6 if rng.random() < 0.12 else None) for r in range(22) for c in range(19)]
    cells = spark.createDataFrame(rows, "r int, c int, plan int, area long")
    for_area = lambda tile: {tuple(r) for r in walk.served_by_area(cells, F.col("area"), F.col("plan") == 2, F.col("plan") == 0, 300.0, 100.0, tile).collect()}
    areas = cells.where("area IS NOT NULL").select("area").distinct()
    every = cells.withColumnRenamed("area", "own").crossJoin(areas)  # a small fixture
    field = walk.walk_field(every, F.coalesce(F.col("own") == F.col("area"), F.lit(False)), F.col("plan") == 0, 300.0, 100.0, ("area",))
    served = field.join(cells.where("plan = 2").select("r", "c"), ["r", "c"]).groupBy("area").agg(F.count("*").alias("n"), F.sum("n_orth").alias("o"), F.sum("n_diag").alias("d"))
    want = {tuple(r) for r in served.collect()}
    assert {x for x in for_area(5) if x[1]} == {x for x in for_area(64) if x[1]} == want


@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_of_a_collection_give_its_features(spark, tmp_path, indent):

    def shape(i):
        at = [i, i + 0.5]
        kinds = [("Point", at), ("LineString", [at, [0, 1]]), ("Polygon", [[at, [0, 1], [5, 5], at]]), ("MultiPolygon", [[[at, [0, 1], [5, 5], at]], [[at, [9, 1], [5, 5], at]]])]
        return None if i % 11 == 7 else dict(zip(("type", "coordinates"), kinds[i % 4]))

    for name, n in (("large", 300), ("one", 1), ("none", 0)):
        every = [{"type": "Feature", "id": i, "properties": {"name": f"é {{ ] }} \\\"Feature\\\" {i}", "long": "x" * (i % 50)}, "geometry": shape(i)} for i in range(n)]
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": every, "crs": "none"}, indent=indent, ensure_ascii=False))
    rows = lambda df: sorted((r.dataset, r.fid, r.geom_type, str(r.rings), str(r.props)) for r in df.collect())
    want = rows(geojson.features(spark, str(tmp_path)))
    assert len(want) == 300 - 27 + 1
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            ranged = geojson.feature_ranges(spark, str(tmp_path))
            assert rows(ranged) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"Feature"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    with pytest.raises(Exception, match="no feature"):
        geojson.feature_ranges(spark, str(tmp_path / "bad.geojson")).collect()


def test_parameter_and_file_lines(spark):
    dials = "id int, block_m double, iterations int, target double, build double, isolated double, walk_m double, centre_walk_m double, green_walk_m double, span_m double, d_high double, d_medium double, d_low double, p_high double, p_medium double, p_low double, least_cells int, optimise boolean, members int"
    full = (1, 50.0, 20, 12000.0, 0.3, 0.0001, 600.0, 800.0, 0.0, 100.0, 6000.0, 3000.0, 1000.0, 0.25, 0.25, 0.5, 4, True, 10)
    rows = spark.createDataFrame([full, (2, *[None] * 18)], dials)
    lines = {(x.id, x.line_no): x.line for x in report.parameter_lines(rows).collect()}
    assert len(lines) == 24 and all(len(x.split(": ", 1)[0]) == 24 for x in lines.values())
    assert [lines[1, i].split(": ", 1)[1] for i in (2, 3, 4, 5, 6, 9)] == ["12,000", "0.3", "Moderate", "800 m", "600 m", "~28 people (4 cells)"]
    assert lines[2, 3].endswith(": -") and lines[2, 9].endswith(": -")
    files = spark.createDataFrame([(1, 1, "b.tif", "two"), (1, 0, "long.json", "one"), (1, 1, "b.tif", None), (2, 0, None, "x")], "run int, ord int, name string, label string")
    assert [(x.run, x.line_no, x.line) for x in report.file_lines(files).orderBy("run", "line_no").collect()] == [(1, 0, "  long.json  one"), (1, 1, "  b.tif      "), (1, 2, "  b.tif      two"), (2, 0, "  -  x")]
    assert report.file_lines(files.where("false")).count() == 0 and report.parameter_lines(rows.where("false")).count() == 0


def test_a_snapshot_keeps_built_land(spark):
    cells = spark.createDataFrame([(0, c) for c in range(6)], "r int, c int")
    on = [("built", 0), ("unbuildable", 0), ("centres", 0), ("green", 1), ("unbuildable", 1), ("centres", 2), ("green", 3), ("built", 3), ("built", 3), (None, 4), ("other", 5)]
    layers = spark.createDataFrame([(k, 0, c) for k, c in on], "layer string, r int, c int")
    got = {x.c: (x.state, x.origin, x.seed) for x in raster.snapshot(cells, layers).collect()}
    assert got == {0: (1, 1, True), 1: (-1, 0, False), 2: (0, -1, False), 3: (1, 1, False), 4: (0, -1, False), 5: (0, -1, False)}
