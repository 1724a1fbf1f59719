"""Polygons as edges against brute force on fine grids, and closed forms."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from footgrid.operators import polygons as pg, raster

EDGES = "x0 long, y0 long, x1 long, y1 long"


def edges_of(fid, *loops):
    return [(fid, *a, *b) for loop in loops for a, b in zip(loop, [*loop[1:], loop[0]])]


def inside(edges, x, y):
    """Even-odd, by a ray upwards."""
    return sum((min(a, c) <= x < max(a, c)) and y < b + (d - b) * (x - a) / (c - a) for a, b, c, d in edges if a != c) % 2 == 1


def winding(edges, x, y):
    return sum((1 if c < a else -1) for a, b, c, d in edges if a != c and min(a, c) <= x < max(a, c) and y < b + (d - b) * (x - a) / (c - a))


def frame(spark, rows, keys="fid long"):
    return spark.createDataFrame(rows, f"{keys}, {EDGES}")


def area(edges):
    return sum(a * d - c * b for a, b, c, d in edges) / 2


def sampled(area_of, size, n=160):
    """Area by sample points off the grid's lines."""
    step = size / n
    return sum(area_of((i + 0.5) * step + 0.013, (j + 0.5) * step + 0.007) for i in range(n) for j in range(n)) * step * step


def star(x, y, size, k=5):
    at = [(round(x + size * math.sin(4 * math.pi * i / k)), round(y + size * math.cos(4 * math.pi * i / k))) for i in range(k)]
    return at


SHAPES = {
    1: [[(0, 0), (1000, 1000), (1000, 0), (0, 1000)]],  # a bow-tie
    2: [star(500, 500, 500)],  # a pentagram, hollow by the even-odd rule
    3: [[(0, 0), (900, 0), (900, 900), (0, 900)], [(300, 300), (600, 300), (600, 600), (300, 600)]],  # with a hole, however it turns
    4: [[(0, 0), (600, 0), (600, 600), (0, 600)], [(300, 300), (900, 300), (900, 900), (300, 900)]],  # two that overlap
    5: [[(0, 0), (500, 0), (500, 500), (0, 500)], [(0, 0), (500, 0), (500, 500), (0, 500)]],  # twice the same: nothing
    6: [[(0, 0), (800, 0), (800, 0), (800, 400), (400, 400), (800, 400), (800, 800), (0, 800)]],  # a spike and a point twice
    7: [[(0, 0), (500, 0), (1000, 0), (1000, 1000), (0, 1000)]],  # a point on a straight side
    8: [[(0, 1000), (0, 0), (1000, 1000), (1000, 0)]],
    9: [[(500, 0), (1000, 500), (500, 1000), (0, 500)], [(500, 200), (800, 500), (500, 800), (200, 500)], [(500, 400), (600, 500), (500, 600), (400, 500)]],  # an island in a hole
}


@pytest.mark.parametrize("tile", [pg.TILE, 170])
def test_valid_polygons_enclose_the_same_land(spark, tile):
    rng = random.Random(3)
    shapes = SHAPES | {20 + i: [[(rng.randint(0, 1000), rng.randint(0, 1000)) for _ in range(rng.randint(3, 9))]] for i in range(12)}
    rows = [e for fid, loops in shapes.items() for e in edges_of(fid, *loops)]
    got = pg.valid(frame(spark, rows).where("x0 <> x1 OR y0 <> y1"), tile=tile)
    out = defaultdict(list)
    for r in got.collect():
        out[r.fid].append((r.x0, r.y0, r.x1, r.y1))
    assert 5 not in out
    for fid in shapes:
        own = [e[1:] for e in rows if e[0] == fid]
        want = sampled(lambda x, y: inside(own, x, y), 1000, 100)
        assert abs(area(out[fid]) - want) < 0.012 * 1e6, fid
        near = 0
        for _ in range(200):  # the inside is where the left of every edge is
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
            near += winding(out[fid], x, y) != int(inside(own, x, y))
        assert near <= 2, fid  # cuts are rounded to the grid
    n = {r.fid: (r.n, r.holes) for r in pg.ring_measures(pg.rings(got, ("fid",)), ("fid",)).groupBy("fid").agg(F.count("ring").alias("n"), F.sum((F.col("area2") < 0).cast("int")).alias("holes")).collect()}
    assert (n[3], n[9], n[7]) == ((2, 1), (3, 1), (1, 0))
    assert area(out[6]) == 640_000 and area(out[1]) == 500_000
    assert pg.valid(frame(spark, []), tile=tile).count() == 0


@pytest.mark.parametrize("how", ["union", "intersection", "difference"])
def test_overlay_of_many_polygons(spark, how):
    rng = random.Random(5)

    def some(n):
        loops = []
        for _ in range(n):
            x, y, s = rng.randint(0, 700), rng.randint(0, 700), rng.randint(50, 300)
            at = sorted((rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7))))
            loops.append([(round(x + s / 2 + s / 2 * math.cos(t)), round(y + s / 2 + s / 2 * math.sin(t))) for t in at])
        return loops

    left, right = {g: some(6) for g in range(3)}, {g: some(5) for g in range(3)}
    left[3], right[3] = [[(0, 0), (400, 0), (400, 400), (0, 400)]], [[(100, 0), (300, 0), (300, 400), (100, 400)], [(400, 100), (500, 100), (500, 300), (400, 300)]]  # shared sides
    a, b = ([e for g, loops in side.items() for loop in loops for e in edges_of(g, loop)] for side in (left, right))
    got = pg.overlay(frame(spark, a), frame(spark, b), how, tile=120)
    out = defaultdict(list)
    for r in got.collect():
        out[r.fid].append((r.x0, r.y0, r.x1, r.y1))
    rule = {"union": lambda p, q: p or q, "intersection": lambda p, q: p and q, "difference": lambda p, q: p and not q}[how]
    for g in range(4):
        ea, eb = [e[1:] for e in a if e[0] == g], [e[1:] for e in b if e[0] == g]
        bad = 0
        for _ in range(400):
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
            bad += winding(out[g], x, y) != int(rule(winding(ea, x, y) > 0, winding(eb, x, y) > 0))
        assert bad <= 4, (g, bad)
    assert area(out[3]) == {"union": 180_000, "intersection": 80_000, "difference": 80_000}[how]


def test_clips_and_cuts_of_features_that_meet(spark):
    box = lambda fid, x, y, w, h: edges_of(fid, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    a = box(1, 0, 0, 100, 100) + box(2, 300, 0, 90, 90) + box(3, 1000, 1000, 10, 10)
    b = box(7, 50, 50, 100, 100) + box(8, 20, -10, 10, 200) + box(9, 320, 20, 20, 20)
    one, two = frame(spark, a), frame(spark, b)
    got = pg.clipped(one, two, 64).groupBy("fid", "other").agg(pg.twice_area().alias("a")).collect()
    assert {(r.fid, r.other): int(r.a) / 2 for r in got} == {(1, 7): 2500, (1, 8): 1000, (2, 9): 400}
    left = pg.cut_out(one, two, 64)
    assert {r.fid: int(r.a) / 2 for r in left.groupBy("fid").agg(pg.twice_area().alias("a")).collect()} == {1: 6500, 2: 7700, 3: 100}
    found = {(r.fid, r.area, r.rings) for r in pg.large_parts(left, ("fid",), 0.0, 1).select("fid", "area", "rings").collect()}
    assert found == {(1, 2000.0, 1), (1, 4500.0, 1), (2, 7700.0, 2), (3, 100.0, 1)}
    assert {r.area for r in pg.large_parts(left, ("fid",), 4000.0, 1).collect()} == {4500.0, 7700.0}


def test_outlines_of_cells(spark):
    rng = random.Random(8)
    grid = [(k, r, c) for k in (1, 2) for r in range(14) for c in range(11) if rng.random() < 0.6]
    cells = spark.createDataFrame(grid, "band int, r int, c int")
    linked = pg.rings(pg.dissolved(pg.cell_edges(cells, ("band",)), ("band",)), ("band",)).cache()
    for band in (1, 2):
        own = {(r, c) for k, r, c in grid if k == band}
        rows = [r for r in linked.collect() if r.band == band]
        assert sum(r.x0 * r.y1 - r.x1 * r.y0 for r in rows) == 2 * len(own)
        assert len(rows) == sum((r + a, c + b) not in own for r, c in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        loops = defaultdict(dict)
        for r in rows:
            loops[r.ring][r.pos] = (r.x0, r.y0, r.x1, r.y1)
        for loop in loops.values():
            at = [loop[i] for i in range(len(loop))]
            assert all(p[2:] == q[:2] for p, q in zip(at, at[1:] + at[:1]))

        def pieces(cells, steps):
            left, n = set(cells), 0
            while left:
                todo, n = [left.pop()], n + 1
                while todo:
                    r, c = todo.pop()
                    for a, b in steps:
                        if (r + a, c + b) in left:
                            left.remove((r + a, c + b))
                            todo.append((r + a, c + b))
            return n

        rook = [(0, 1), (1, 0), (0, -1), (-1, 0)]
        shells = pieces(own, rook)
        holes = pieces({(r, c) for r in range(-1, 15) for c in range(-1, 12)} - own, [*rook, (1, 1), (1, -1), (-1, 1), (-1, -1)]) - 1
        assert sum(sum(x0 * y1 - x1 * y0 for x0, y0, x1, y1 in loop.values()) > 0 for loop in loops.values()) == shells
        assert len(loops) == shells + holes
    features = pg.as_features(linked.where("band = 1"), ("band",), 1).collect()
    assert len(features) == 1 and all(ring[0] == ring[-1] for ring in features[0].rings)
    burned = raster.burned(raster.ring_edges(spark.createDataFrame(features), "band"), 1.0, 0.0, 0.0, ("band",))
    assert {(r.r, r.c) for r in burned.collect()} == {(r, c) for k, r, c in grid if k == 1}


def test_an_edge_passes_its_tiles(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.randint(-900, 900) for _ in range(4))) for i in range(60)] + [(100, 5, -300, 5, 300), (101, -300, 7, 300, 7)]
    got = defaultdict(set)
    for r in pg.passed_tiles(frame(spark, rows), 100).collect():
        got[r.fid].add((r.tx, r.ty))
    for fid, x0, y0, x1, y1 in rows:
        want = {((x0 + (x1 - x0) * t / 5000) // 100, (y0 + (y1 - y0) * t / 5000) // 100) for t in range(5001)}
        assert want <= got[fid] and len(got[fid]) <= 2 * len(want) + 4


@pytest.mark.parametrize("tile", [64, 1000])
def test_a_layer_is_merged_whatever_the_tiles(spark, tile):
    rng = random.Random(2)
    rows = []
    for fid in range(60):
        x, y, w, h = rng.randint(-500, 400), rng.randint(-500, 400), rng.randint(1, 200), rng.randint(1, 200)
        rows += edges_of(fid, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    rows += edges_of(99, [(-63, -64), (65, 64), (64, 200)]) + edges_of(98, [(-600, -33), (600, -31), (600, -30)])  # through corners of tiles
    out = [(r.x0, r.y0, r.x1, r.y1) for r in pg.merged_layer(frame(spark, rows), tile).collect()]
    bad = 0
    for _ in range(1500):
        x, y = rng.uniform(-620, 620), rng.uniform(-620, 620)
        bad += winding(out, x, y) != int(any(winding([e[1:] for e in rows if e[0] == fid], x, y) > 0 for fid in {e[0] for e in rows}))
    assert bad <= 3


def test_corridors_along_lines(spark):
    lines = [(1, 0, 0, 1000, 0), (1, 1000, 0, 1000, 800), (2, 0, 0, 0, 500), (3, 50, 50, 600, 700), (3, 600, 700, 50, 60)]
    got = defaultdict(list)
    for r in pg.widened(frame(spark, lines), 100, tile=300).collect():
        got[r.fid].append((r.x0, r.y0, r.x1, r.y1))
    disk = 0.5 * 32 * 100**2 * math.sin(2 * math.pi / 32)
    assert abs(area(got[2]) - (500 * 200 + disk)) < 600 and abs(area(got[1]) - (1000 * 200 + 800 * 200 - 100 * 100 + disk * 1.25)) < 800
    far = lambda e, x, y: math.hypot(x - e[0] - (t := min(1, max(0, ((x - e[0]) * (e[2] - e[0]) + (y - e[1]) * (e[3] - e[1])) / ((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2)))) * (e[2] - e[0]), y - e[1] - t * (e[3] - e[1]))
    rng = random.Random(7)
    for fid in (1, 2, 3):
        own = [e[1:] for e in lines if e[0] == fid]
        for _ in range(300):
            x, y = rng.uniform(-150, 1150), rng.uniform(-150, 950)
            near = min(far(e, x, y) for e in own)
            if abs(near - 100) > 2:
                assert winding(got[fid], x, y) == int(near < 100)


def test_features_are_repaired_and_extracted(spark):
    def ring(*at):
        return [(float(x), float(y)) for x, y in [*at, at[0]]]

    bow, spiked = ring((0, 0), (100, 100), (100, 0), (0, 100)), ring((0, 0), (200, 0), (200, 100), (900, 100), (200, 100), (200, 200), (0, 200))
    wavy = ring(*[(i * 10, (i % 2) * 2) for i in range(30)], (290, 300), (0, 300))
    rows = [(1, "Polygon", [bow], "a"), (2, "Polygon", [spiked], "b"), (3, "LineString", [[(0.0, 0.0), (5.0, 5.0)]], "c"), (4, "Polygon", [ring((1, 1), (5, 5))], "d"), (5, "Polygon", [wavy], "e")]
    table = spark.createDataFrame(rows, "fid long, geom_type string, rings array<array<struct<x:double,y:double>>>, name string")
    fixed = {r.fid: r for r in pg.repaired(table).collect()}
    assert set(fixed) == {1, 2, 3, 5} and fixed[3].rings == [[(0.0, 0.0), (5.0, 5.0)]] and fixed[2].name == "b"
    shoelace = lambda rings: sum(p.x * q.y - q.x * p.y for ring in rings for p, q in zip(ring, ring[1:])) / 2
    assert len(fixed[1].rings) == 2 and shoelace(fixed[1].rings) == 5000 and shoelace(fixed[2].rings) == 40_000 and len(fixed[2].rings[0]) == 5
    area = frame(spark, edges_of(9, [(0, 0), (100_000, 0), (100_000, 250_000), (0, 250_000)]))
    got = [(r.fid, r.area, len(r.rings)) for r in pg.extracted(table, area).collect()]
    # The bow-tie's halves meet in a point: two parts of 2500; the wavy side is laid straight within 6 m.
    assert sorted(got)[:3] == [(1, 2500.0, 1), (1, 2500.0, 1), (2, 20_000.0, 1)] and len(got) == 4
    assert abs(sorted(got)[3][1] - 24_900) <= 600


def test_exact_cuts_take_one_round_and_rounded_ones_go_on(spark, monkeypatch):
    calls, cuts = [], pg._cuts
    monkeypatch.setattr(pg, "_cuts", lambda *a: calls.append(1) or cuts(*a))
    box = lambda x, y, n: [(x, y, x + n, y), (x + n, y, x + n, y + n), (x + n, y + n, x, y + n), (x, y + n, x, y)]
    ends = "x0 long, y0 long, x1 long, y1 long"
    assert pg.noded(spark.createDataFrame([*box(0, 0, 10), *box(5, 5, 10)], ends)).count() == 12 and len(calls) == 1
    # They meet beside the grid: what is bent there is compared once more.
    assert pg.noded(spark.createDataFrame([(0, 0, 5, 2), (0, 1, 4, 0)], ends)).count() == 4 and len(calls) == 3


def test_rings_are_numbered_alike_whatever_batches_chain_them(spark):
    box = lambda x, n: [e for i in range(n) for e in ((x + i, 0, x + i + 1, 0), (x + i + 1, 9, x + i, 9))] + [(x + n, 0, x + n, 9), (x, 9, x, 0)]
    edges = spark.createDataFrame([*box(0, 5), *box(20, 2), *box(40, 9)], "x0 long, y0 long, x1 long, y1 long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    try:
        for batch, span in (("3", 7), (was, 1000)):
            spark.conf.set(size, batch)
            found = {}
            for x in pg.rings(edges, (), span).collect():
                found.setdefault(x.ring, []).append((x.pos, x.x0, x.y0, x.x1, x.y1))
            assert sorted(map(len, found.values())) == [6, 12, 20]
            for ring in map(sorted, found.values()):
                assert [e[0] for e in ring] == list(range(len(ring))) and all(a[3:] == b[1:3] for a, b in zip(ring, [*ring[1:], ring[0]]))
    finally:
        spark.conf.set(size, was)
    import pandas as pd

    # A ring that lies within a batch is done there; nothing is left to link on.
    done = next(pg._chained([pd.DataFrame({"id": [1, 2, 3], "after": [2, 3, 1]})])).dropna()
    assert [(x.id, x.to, x.n, x.low) for x in done.itertuples()] == [(1, 1, 3, 1)]


def test_corridors_of_few_lines_are_united_in_batches_as_tables_do(spark, monkeypatch):
    """Crossing, touching, equal, opposite and far lines; groups that batches break, one too large for a batch's work, edges without a key; no table of sides is written for small groups."""
    rng = random.Random(41)
    at = lambda: rng.randrange(-3000, 3000)
    lines = [(f, at(), at(), at(), at()) for f, n in ((1, 1), (2, 2), (3, 3), (4, 5), (5, 9), (None, 4)) for _ in range(n)]
    lines += [(6, 0, 0, 900, 300), (6, 0, 0, 900, 300), (6, 900, 300, 0, 0), (7, 0, 0, 500, 0), (7, 500, 0, 500, 1000), (7, 100, 0, 800, 0), (8, 0, 0, 10, 10), (8, 9000, 0, 9000, 9)]
    lines = spark.createDataFrame([(f, x0, y0 + 7 * 10**9, x1, y1 + 7 * 10**9) for f, x0, y0, x1, y1 in lines], "fid long, x0 long, y0 long, x1 long, y1 long")
    found = lambda df: {r.fid: r for r in df.groupBy("fid").agg((pg.twice_area() / 2).cast("double").alias("area"), F.count("x0").alias("n")).collect()}
    want = found(pg.widened(lines, 400, most=0))
    overlays, tables = [], pg.overlay
    monkeypatch.setattr(pg, "overlay", lambda *a: overlays.append(1) or tables(*a))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    try:
        for batch, most, n in (("2", 32, 0), (was, 32, 0), ("7", 5, 1)):
            spark.conf.set(size, batch)
            got = pg.widened(lines, 400, most=most)
            assert len(overlays) == n and got.groupBy("fid", "x0", "y0").count().join(got.groupBy("fid", F.col("x1").alias("x0"), F.col("y1").alias("y0")).count(), ["x0", "y0", "count"]).count() > 300
            assert set(found(got)) == set(want) == set(range(1, 9))
            # Which of two edges a crossing is reckoned along is open: it may be a step of the grid aside.
            assert all(abs(r.area - want[f].area) <= 40_000 and abs(r.n - want[f].n) <= 4 for f, r in found(got).items())
    finally:
        spark.conf.set(size, was)
    assert pg.widened(lines.where("fid > 99"), 400).count() == 0
