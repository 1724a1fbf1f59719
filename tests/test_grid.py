"""Micro-cases with known answers, invariants, and parity of the tile-based operators with plain loops."""

from __future__ import annotations

import heapq
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footgrid.functions import codes, params
from footgrid.operators import components as comp, neighbours as nb, raster, walk
from footgrid.plans import centres, classify, growth, score, tiers

SF = "/root/testdata/sf0.001"


def frame(spark, grid, name="state"):
    grid = np.asarray(grid)
    r, c = np.indices(grid.shape)
    return spark.createDataFrame(pd.DataFrame({"r": r.ravel().astype("int32"), "c": c.ravel().astype("int32"), name: grid.ravel()})).withColumn("r", F.col("r").cast("int")).withColumn("c", F.col("c").cast("int"))


def test_bounds_snap_to_whole_cells(spark):
    b = spark.createDataFrame([(10.0, 20.0, 290.0, 310.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(raster.aligned(b, 100.0).first()) == (4, 3, 0.0, 400.0)


def test_scanlines_fill_like_an_even_odd_test(spark):
    ring = [(1.0, 1.0), (9.5, 2.2), (6.1, 5.0), (9.0, 9.3), (3.0, 7.7), (1.2, 9.0)]
    edges = [("p", *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(edges, "pid string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.r, r.c) for r in raster.burned(df, 1.0, 0.0, 12.0).collect()}
    want = set()
    for r in range(12):
        for c in range(12):
            x, y = c + 0.5, 12 - r - 0.5
            crossings = sum(((y0 <= y) != (y1 <= y)) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for _, x0, y0, x1, y1 in edges)
            if crossings % 2:
                want.add((r, c))
    assert got == want
    assert got <= {(r.r, r.c) for r in raster.burned_all_touched(df, 1.0, 0.0, 12.0).collect()}


@pytest.mark.parametrize("flags,want", [([1] * 8, (8, 8, 1)), ([1, 0, 0, 0, 1, 0, 0, 0], (2, 1, 2)), ([1, 1, 0, 0, 0, 1, 1, 1], (5, 5, 1)), ([0] * 8, (0, 0, 0)), ([1, 0, 1], (2, 1, 2))])
def test_ring_runs(spark, flags, want):
    a = F.array(*[F.lit(str(f)) for f in flags])
    assert tuple(spark.range(1).select(*nb.runs(a)).first()) == want
    assert growth.Growth.runs([bool(f) for f in flags]) == (want[1], want[2])


def test_spans_end_at_other_states_and_at_the_edge(spark):
    line = {r.c: r for r in nb.green_spans(frame(spark, [[0, 0, 0, 1, 0]])).collect()}
    assert (line[0].right, line[0].right_end) == (2, 1) and (line[4].left, line[4].left_end) == (0, 1) and line[4].right_end is None
    ok = lambda g: {r.c: r.ok for r in nb.span_admissible(nb.green_spans(frame(spark, [g])), 3.0).collect()}
    assert ok([1, 0, 0, 0, -1])[1] and not ok([1, 0, 0, 0, 1])[1]


@pytest.mark.parametrize("queen", [True, False])
def test_components_of_a_random_mask_over_small_tiles(spark, queen):
    mask = np.random.default_rng(5).random((36, 48)) < 0.4
    got = comp.numbered(comp.components(frame(spark, mask.astype(int)).where("state = 1"), queen, tile=8)).collect()
    want, n = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if not want[r, c]:
            n += 1
            stack = [(r, c)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < 36 and 0 <= x < 48 and mask[y, x] and not want[y, x]:
                    want[y, x] = n
                    stack += [(y + a, x + b) for a, b in (codes.QUEEN if queen else codes.ROOK)]
    assert {(r.r, r.c, r.label) for r in got} == {(int(r), int(c), int(want[r, c])) for r, c in np.argwhere(mask)}


def dijkstra(targets, blocked, bound):
    dist, heap = {}, [(0.0, int(r), int(c)) for r, c in targets]
    best = {(r, c): 0.0 for _, r, c in heap}
    while heap:
        d, r, c = heapq.heappop(heap)
        if (r, c) in dist:
            continue
        dist[r, c] = d
        for a, b in codes.QUEEN:
            q, n = (r + a, c + b), d + math.hypot(a, b)
            if 0 <= q[0] < blocked.shape[0] and 0 <= q[1] < blocked.shape[1] and not blocked[q] and n <= bound + 1e-9 and n < best.get(q, 1e9):
                best[q] = n
                heapq.heappush(heap, (n, *q))
    return dist


def test_walks_around_obstacles_over_small_tiles(spark):
    rnd = np.random.default_rng(11)
    target, blocked = rnd.random((40, 55)) < 0.02, rnd.random((40, 55)) < 0.3
    df = frame(spark, target.astype(int) + 2 * blocked.astype(int))
    got = walk.walk_field(df, F.col("state") % 2 == 1, F.col("state") >= 2, 700.0, 100.0, tile=16).collect()
    want = dijkstra(np.argwhere(target), blocked, 7.0)
    assert {(r.r, r.c) for r in got} == set(want)
    assert all(abs(r.dist - 100 * want[r.r, r.c]) < 1e-6 for r in got)


def test_reach_and_counts_agree(spark):
    grid = np.where(np.random.default_rng(2).random((20, 24)) < 0.25, -1, 0)
    df = frame(spark, grid).withColumn("src", (F.col("r") * 24 + F.col("c")) % 17 == 0)
    pairs = walk.reach(df, F.col("src"), F.col("state") >= 0, F.col("state") >= 0, 300.0, 100.0, tile=8)
    counts = walk.access_counts(df, F.col("src"), F.col("state") >= 0, 300.0, 100.0, tile=8)
    assert sorted(map(tuple, pairs.groupBy("r", "c").count().collect())) == sorted(map(tuple, counts.collect()))
    five = frame(spark, [[0] * 5])
    assert walk.reach(five, F.col("c") == 0, F.col("state") == 0, F.col("state") == 0, 4.0, 1.0).count() == 5
    assert walk.reach(five, F.col("c") == 0, F.col("state") == 0, F.col("state") == 0, 2.0, 1.0).count() == 3


def test_interior_points(spark):
    square, shape = np.zeros((9, 9), int), np.zeros((9, 9), int)
    square[1:8, 1:8] = 1
    shape[1:8, 1:3] = shape[5:8, 1:8] = 1
    assert centres.inner_point(square.astype(bool)) == (4, 4) and centres.inner_point(np.zeros((3, 3), bool)) is None
    for g in (square, shape):
        got = centres.interior_points(comp.components(frame(spark, g).where("state = 1"))).first()
        assert (got.r, got.c) == centres.inner_point(g.astype(bool))


@pytest.mark.parametrize("tile", [4, 7, 256])
@pytest.mark.parametrize("queen", [True, False])
def test_inner_points_across_tiles(spark, tile, queen):
    """As of each component's own mask, whatever the tiles; parts that touch at corners only, too."""
    rng = np.random.default_rng(tile)
    grid = (rng.random((40, 33)) < 0.85).astype(int)
    grid[5:32, 8:30] = 1
    grid[20, :] = 0
    labels = comp.components(frame(spark, grid).where("state = 1"), queen)
    got = {r.root: (r.r, r.c) for r in centres.interior_points(labels, tile).collect()}
    rows = labels.toPandas()
    assert set(got) == set(rows["root"])
    for root, own in rows.groupby("root"):
        mask = np.zeros((40, 33), bool)
        mask[own["r"], own["c"]] = True
        assert got[root] == centres.inner_point(mask)


@pytest.mark.parametrize("tile", [3, 5, 256])
def test_spans_and_box_sums_across_tiles(spark, tile):
    rng = np.random.default_rng(2)
    grid = rng.choice([-1, 0, 0, 0, 0, 0, 1], (17, 23))
    grid[3] = 0
    cells = frame(spark, grid)
    for r in nb.green_spans(cells, tile).collect():
        for name, dr, dc in (("left", 0, -1), ("right", 0, 1), ("up", -1, 0), ("down", 1, 0)):
            n, a, b = 0, r.r + dr, r.c + dc
            while 0 <= a < 17 and 0 <= b < 23 and grid[a, b] == 0:
                n, a, b = n + 1, a + dr, b + dc
            assert (r[name], r[f"{name}_end"]) == (n, int(grid[a, b]) if 0 <= a < 17 and 0 <= b < 23 else None)
    sums = {(r.r, r.c): r.s for r in nb.box_sum(cells.where("NOT (r = 4 AND c = 4)"), (F.col("state") == 1).cast("int"), 2, tile).collect()}
    left = grid.copy()
    left[4, 4] = 0
    assert sums == {(a, b): int((left[max(0, a - 2) : a + 3, max(0, b - 2) : b + 3] == 1).sum()) for a in range(17) for b in range(23) if (a, b) != (4, 4)}


def test_likelihood_of_two_members(spark):
    rows = [(m, r, c, s) for m, g in enumerate(([[1, 0], [0, 2]], [[1, 0], [1, 2]])) for r, line in enumerate(g) for c, s in enumerate(line)]
    got = {(r.r, r.c): (r.p_built, r.p_green) for r in growth.likelihood(spark.createDataFrame(rows, "member int, r int, c int, state int")).collect()}
    assert got == {(0, 0): (1.0, 0.0), (0, 1): (0.0, 1.0), (1, 0): (0.5, 0.5), (1, 1): (0.0, 0.0)}


def test_a_block_with_one_centre(spark):
    plan = np.zeros((24, 24), int)
    plan[4:20, 4:20], plan[11, 11], plan[4:20, 20:24] = 2, 3, 1
    df = frame(spark, plan, "plan")
    s = score.coverage(score.distances(df, 100.0, 800.0, 400.0, 400.0), 800.0, 400.0).first()
    assert s.built_cells == 256 and abs(s.served_coverage + s.unserved_fraction - 1) < 1e-9 and 0 < s.green_coverage < 1
    assert abs(s.access_cost - 0.5 * (s.centre_access + s.green_access)) < 1e-3
    six = np.zeros((12, 30), int)
    six[2:8, 2:8], six[4, 4], six[4, 25] = 2, 3, 3
    audit = sorted(score.centre_audit(frame(spark, six, "plan"), 100.0, 1000.0).collect(), key=lambda r: (r.served, r.root))
    assert [r.served for r in audit] == [1, 36]


def test_satellites_go_and_infill_becomes_old(spark):
    plan = np.zeros((30, 40), int)
    plan[5:15, 5:15], plan[20:24, 20:24], plan[2:4, 30:33] = 4, 2, 2
    plan[15:16, 6:9] = 2
    out = {(r.r, r.c): r.plan for r in classify.pruned(frame(spark, plan, "plan"), 12).collect()}
    assert out[2, 30] == 1 and out[20, 20] == 2 and out[5, 5] == 4 and out[15, 6] == 2
    out = {(r.r, r.c): r.plan for r in classify.absorbed(frame(spark, plan, "plan"), 5).collect()}
    assert out[15, 6] == 4 and out[20, 20] == 2


def test_tiers_fall_away_from_the_centre(spark):
    plan = np.full((1, 30), 2)
    plan[0, 0] = 3
    dist = score.distances(frame(spark, plan, "plan"), 100.0, 5000.0, 400.0, 0.0)
    got = [r.density for r in tiers.arranged(dist, (0.2, 0.3, 0.5), (6000.0, 3000.0, 1000.0)).orderBy("c").collect()]
    assert got == [6000.0] * 6 + [3000.0] * 9 + [1000.0] * 15


def small(iterations=8, **over):
    return params.Params(**{"build": 0.6, "near": 0.1, "isolated": 0.01, "iterations": iterations, "target": 1e6, **over})


def test_growth_keeps_its_access_counts_as_a_rebuild_would():
    state, origin = np.zeros((24, 24), int), np.full((24, 24), -1)
    state[:, 10], state[12, 4], origin[12, 4], origin[0, :5] = -1, 2, 2, 0
    g = growth.Growth(state, origin, small(), 3)
    g.run()
    again = growth.Growth(g.state, origin, small(), 3)
    assert (again.green_acc == g.green_acc).all() and (again.itx == g.itx).all() and (g.state[0, :5] == 0).all()
    assert (g.state > 0).sum() > 5 and ((g.green_acc > 0) | (g.state <= 0)).all()


def test_members_do_not_depend_on_batches_or_partitions(spark):
    state = np.zeros((20, 20), int)
    state[10, 10] = 2
    cells = frame(spark, state).withColumn("origin", F.when(F.col("state") == 2, 2).otherwise(-1))
    all_ = growth.ensemble(cells, small(4), 5, range(3)).select("member", "r", "c", "state", "density")
    one = growth.ensemble(cells.repartition(7), small(4), 5, [1]).select("member", "r", "c", "state", "density")
    assert sorted(map(tuple, all_.where("member = 1").collect())) == sorted(map(tuple, one.collect()))
    assert all_.where("member <> 1").select("r", "c", "state").exceptAll(one.select("r", "c", "state")).count() > 0
    with pytest.raises(ValueError):
        growth.ensemble(cells, small(), 5, [0], most_cells=10)


def test_rows_made_of_small_files_are_neither_broadcast_nor_made_in_one_task(spark):
    cells = frame(spark, np.ones((6, 6), int))
    seeds = cells.where("r = c").select(F.col("r").alias("ord"), "r", "c")
    edges = seeds.select(F.col("ord").alias("fid"), *[F.lit(v).alias(n) for v, n in zip((0.0, 0.0, 300.0, 200.0), ("x0", "y0", "x1", "y1"))])
    near, corridors = raster.nearest_built(seeds, cells, 8), raster.buffered_line_cells(edges, cells, 100.0, 0.0, 600.0, 150.0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in plan(df) for df in (nb.ring_runs(cells, F.col("n_state") > 0), near, corridors))
    assert "REPARTITION_BY_NUM" in plan(corridors) and near.count() == 6 and corridors.where("fid = 0").count() > 6


def test_tiles_grow_what_one_task_would(spark):
    rng = np.random.default_rng(4)
    state = np.where(rng.random((40, 34)) < 0.1, -1, 0)
    state[4:12, 3:11], state[30:36, 20:30], state[20, 5], state[8, 30] = 1, 1, 2, 2
    df = frame(spark, state).withColumn("origin", F.when(F.col("state") == 2, 2).when((F.col("r") + F.col("c")) % 11 == 0, 0).otherwise(-1)).where("r <> 7 OR c <> 20")
    origin = np.full(state.shape, -1)
    for x in df.collect():
        origin[x.r, x.c] = x.origin
    state[7, 20] = -1
    p = small(3)
    got = growth.ensemble(df.withColumn("r", F.col("r") + 5), p, 5, [2], tile=15).collect()
    g = growth.Growth(state, origin, p, growth._seed(5, 2))
    g.run()
    assert len(got) == 40 * 34 - 1 and {x.steps for x in got} == {g.step_no} and {x.population for x in got} == {g.population}
    assert all((x.state, x.density) == (g.state[x.r - 5, x.c], g.density[x.r - 5, x.c]) for x in got)
    assert (g.state == 2).sum() > (state == 2).sum() and (g.state == 1).sum() > (state == 1).sum() + 50


def test_footprints_are_walks():
    open_ = np.random.default_rng(8).random((9, 11)) < 0.7
    side = 2 * 4 + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(open_, 4), (side, side)).reshape(-1, side, side)
    start = np.zeros(windows.shape, bool)
    start[:, 4, 4] = True
    assert (growth.footprints(open_, 4, 4.5).reshape(windows.shape) == (walk.relaxed(start, windows, 4.5)[0] < walk.FAR)).all()


def test_params_are_checked():
    for bad in ({"block_m": 0}, {"walk_m": 50.0}, {"shares": (0.5, 0.5, 0.5)}, {"densities_km2": (1.0, 2.0, 3.0)}, {"build": 1.5}, {"target": 0}):
        with pytest.raises(ValueError):
            params.Params(**bad)
    assert params.Params().per_block == (60.0, 30.0, 10.0) and params.Params().least_cells(100) == 3


def test_documents_report_what_they_ignore(spark):
    rows = [("a", '{"schema":"walk-growth-params/1","grid_size_m":50,"build_prob":"x","odd":1,"ensemble":"false"}'), ("b", "[1]"), ("c", '{"schema":"other"}'), ("d", None), ("e", "no json")]
    got = {(r.doc, r.key): (r.value, r.status) for r in params.loaded(spark.createDataFrame(rows, "doc string, body string")).collect()}
    assert got["a", "grid_size_m"] == ("50.0", "ok") and got["a", "build_prob"] == (None, "malformed") and got["a", "odd"] == (None, "ignored")
    assert {got[d, "schema"][1] for d in "bcde"} == {"error"}


def test_layers_and_map_data_from_files(spark, tmp_path):
    from footgrid.sources import geojson, osm

    (tmp_path / "built.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1.5,2.5]}}]}')
    (tmp_path / "empty.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    rows = geojson.features(spark, str(tmp_path / "*.geojson"))
    assert sorted((r.dataset, r.geom_type, len(r.rings[0])) for r in rows.collect()) == [("built", "Point", 1), ("built", "Polygon", 5)]
    polygon = rows.where("geom_type = 'Polygon'")
    assert raster.burned(raster.ring_edges(polygon), 1.0, 0.0, 4.0, ("fid",)).count() == 16
    assert '"coordinates":[[[0.0,0.0]' in geojson.as_lines(polygon).first().value
    (tmp_path / "m.osm").write_text(
        '<osm><node id="1" lon="0" lat="0"><tag k="highway" v="bus_stop"/></node><node id="2" lon="1" lat="0"/><node id="3" lon="1" lat="1"/><way id="7"><nd ref="1"/><nd ref="2"/><nd ref="9"/></way>'
        '<way id="8"><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way><relation id="5"><member type="way" ref="7" role="outer"/><member type="way" ref="8" role=""/><tag k="type" v="multipolygon"/></relation></osm>'
    )
    path = str(tmp_path / "m.osm")
    points = osm.way_coordinates(osm.ways(spark, path), osm.nodes(spark, path))
    assert {r.way_id: len(r.points) for r in points.collect()} == {"7": 2, "8": 3}
    ring = osm.relation_rings(osm.relations(spark, path), points).first()
    assert ring.rel_id == "5" and len(ring.rings[0]) == 4
    assert osm.nodes(spark, path).where("tags['highway'] = 'bus_stop'").count() == 1


def test_lines_become_corridors(spark):
    edges = spark.createDataFrame([(1, 0.5, 5.5, 9.5, 5.5)], "fid long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.r, r.c) for r in raster.buffered_line_cells(edges, frame(spark, np.zeros((10, 10), int)), 1.0, 0.0, 10.0, 1.0).collect()}
    assert got == {(r, c) for r in (3, 4, 5) for c in range(10)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry_gives_one_row(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tags_parse_with_blanks_and_the_last_of_equal_keys(spark):
    from footgrid.functions import tags

    text = r'"a" => "1","b"=>"x, \"y\" \\z","a"  =>  "2","c"=>""'
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tags.parsed(F.col("t")).alias("m")).collect()
    assert [dict(r.m) for r in rows] == [{"a": "2", "b": 'x, "y" \\z', "c": ""}, {}, {}]


def test_features_go_to_datasets_of_their_kind(spark):
    from footgrid.functions import tags

    rows = [({"highway": "bus_stop"}, "point"), ({"highway": "trunk_link"}, "line"), ({"building": "yes"}, "polygon"), ({"landuse": "quarry"}, "polygon"), ({"military": ""}, "polygon"), ({"landuse": "retail"}, "line"), ({"waterway": "stream"}, "line"), ({"highway": ""}, "line")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, tags map<string,string>, kind string")
    got = sorted((r.id, r.dataset) for r in tags.routed(df, "kind").collect())
    assert got == [(0, "stops"), (1, "streets"), (1, "unbuildable"), (3, "unbuildable"), (4, "unbuildable"), (6, "unbuildable")]
    assert (0, "streets") in {(r.id, r.dataset) for r in tags.routed(df).collect()}


def test_the_options_table_keeps_its_rows(spark):
    from footgrid.plans import report

    metrics = spark.createDataFrame([("x", 1234.5, float("inf"), None)], "option string, population double, centre_walk_mean double, compactness double")
    rows = {r.metric: r.x for r in report.options_table(metrics, "option", ["x"], 2000.0).collect()}
    assert len(rows) == 16 and rows["population accommodated"] == "1,234" and rows["share of target"] == "62%"
    assert {rows["mean walk, served homes: centre (m)"], rows["compactness"], rows["green coverage"]} == {"-"}


def test_every_member_is_scored_and_may_be_best(spark, tmp_path, monkeypatch):
    """The second of seven members alone has a centre: it is found, by the SQL too, with centres as they grew or (were they placed so) placed."""
    import duckdb

    import __spark_entry__ as e

    sf_dir = str(tmp_path)
    orders = [(k, k % 7, "O", 2e5, "3-MEDIUM") for k in range(400)]
    items = [(k, m, "N" if m != 2 or k != 110 else "R") for m in range(1, 8) for k in (110, 111, 210)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{sf_dir}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{sf_dir}/lineitem.parquet")
    with duckdb.connect() as db:
        for name in ("orders", "lineitem"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
        sql = {name: db.sql(e.oracle_sql()[name]).fetchall() for name in ("select_member", "raw_pre_plan")}
    best = [tuple(x) for x in e.queries()["select_member"](spark, sf_dir).collect()]
    assert best == sql["select_member"] and best[0][0] == 2
    plan = sorted(tuple(x) for x in e.queries()["raw_pre_plan"](spark, sf_dir).collect())
    assert plan == sorted(sql["raw_pre_plan"]) and (1, 10, 3) in plan and len(plan) == 400
    monkeypatch.setattr(centres, "keyed_variants", lambda plans, *_: plans.withColumn("mode", F.lit("placed")))
    assert [tuple(x) for x in e.queries()["select_placed_member"](spark, sf_dir).collect()] == best
