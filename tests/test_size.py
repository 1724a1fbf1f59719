"""Work that grows with its input: shuffles that are not multiplied, and shortcuts within tiles held against the long way."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from footgrid.functions import table_functions
from footgrid.operators import components as comp, walk
from footgrid.plans import centres, classify, growth, score
from footgrid.sources import bridge


def test_members_shuffle_cells_and_line_items_once(spark, tmp_path):
    """Odd flags, line numbers no member has, repeated and foreign items; and neither side is multiplied by the members before it is shuffled."""
    orders = [(k, k % 5, "P" if k == 3 else "O", 1e5, "5-LOW") for k in range(6)]
    items = [(0, 1, "N"), (0, 1, "A"), (0, 7, "R"), (1, 2, "B"), (1, 2, "N"), (2, 3, None), (2, 4, None), (2, 4, "N"), (3, 1, "N"), (4, 8, "A"), (4, 5, ""), (4, 5, "A"), (99, 1, "N")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    base = {x.c: x.state for x in bridge.cells(spark, str(tmp_path)).collect()}
    flags: dict = {}
    for k, m, flag in items:
        flags.setdefault((m, k), []).append(flag)
    want = {}
    for m in range(1, 8):
        for k in range(6):
            known = sorted(x for x in flags.get((m, k), []) if x is not None)
            own = {"A": 0, "N": 1}.get(known[0] if known else None, 2) if (m, k) in flags else base[k]
            want[m, k] = -1 if base[k] == -1 else own
    got = bridge.members(spark, str(tmp_path))
    assert {(x.member, x.c): x.state for x in got.collect()} == want and base[3] == -1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = growth.class_counts(bridge.members(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def _members(spark, seed: int, names: tuple[str, ...], *levels) -> pd.DataFrame:
    """Two members' random grids of 41 by 30 cells, some missing, that start at no tile's corner."""
    rnd, parts = np.random.default_rng(seed), []
    for m in (1, 2):
        r, c = (x.ravel() + 5 for x in np.indices((41, 30)))
        part = pd.DataFrame({"member": m, "r": r, "c": c} | {n: rnd.choice(v, len(r), p=p) for n, (v, p) in zip(names, levels)})
        parts.append(part[rnd.random(len(part)) < 0.95])
    return spark.createDataFrame(pd.concat(parts)).select(*[F.col(k).cast("int") for k in ("member", "r", "c", *names)])


def test_tiles_tell_what_labels_tell_without_joins(spark, monkeypatch):
    """Coding, pruning and distances within a halo's tiles against labelled components; and cells are shuffled once."""
    states = _members(spark, 1, ("state", "origin"), ((-1, 0, 1, 2), (0.1, 0.45, 0.4, 0.05)), ((-1, 0, 1), (0.8, 0.1, 0.1))).cache()
    plans = _members(spark, 2, ("plan",), ((0, 1, 2, 3, 4, 5), (0.5, 0.3, 0.14, 0.03, 0.02, 0.01))).cache()
    k = ("member",)
    works = {
        "large": lambda: comp.large_components(states.where("state = 0"), 7, False, k, 8),
        "coded": lambda: classify.state_to_plan(states, 100.0, 300.0, k, ("origin",), 8),
        "pruned": lambda: classify.pruned(plans, 6, k, 8),
        "distances": lambda: score.distances(plans, 100.0, 500.0, 300.0, 300.0, k, 8).select("*"),
    }
    short = {name: f() for name, f in works.items()}
    for df in short.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(comp, "MOST_SEEN", 0)
    monkeypatch.setattr(classify, "MOST_SEEN", 0)
    monkeypatch.setattr(score, "MOST_SEEN", 0)
    for name, f in works.items():
        long = f()
        got, want = (sorted(map(tuple, df.select(long.columns).collect()), key=str) for df in (short[name], long))
        assert got == want and len(want) > 100, name
    assert short["distances"].where("isnan(centre_dist) OR isnan(green_dist)").count() == 0 < short["distances"].where("centre_dist IS NULL").count()


def test_rounds_of_centres_read_packed_tiles_not_cells(spark):
    cells = spark.createDataFrame([(r, c, 3 if (r, c) == (4, 4) else 2) for r in range(9) for c in range(9)], "r int, c int, plan int")
    of = centres.Settlements(cells, 100.0, 200.0, 16)
    points = of.points(3, centres.OWN)
    for rows in (of._moved(points), of._walks(points)):
        assert not [x for x in rows.inputFiles() if "/ground-" in x]
    assert of._lost(points).count() == 81 - 13 and of._lost(points, points).count() == 0


def _flooded(cells: set) -> dict:
    """The first cell of each cell's component by eight directions, found one by one."""
    first: dict = {}
    for at in sorted(cells):
        todo = [at] if at not in first else []
        while todo:
            r, c = todo.pop()
            if (r, c) in cells and (r, c) not in first:
                first[r, c] = at
                todo += [(r + y, c + x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return first


def test_table_functions_take_batches_not_rows(spark):
    """Tiles of several batches and batches of several tiles, at negative rows, with missing cells and null marks; and tables without a row."""
    rnd = np.random.default_rng(23)
    rows = [(r, c, bool(rnd.random() < 0.04) if rnd.random() < 0.9 else None, bool(rnd.random() < 0.7)) for r in range(-30, 23) for c in range(3, 29) if rnd.random() < 0.95]
    cells = spark.createDataFrame(rows, "r int, c int, target boolean, open boolean")
    table_functions.registered(spark)
    table_functions.tiled(cells, F.col("target"), F.col("open"), 450.0, 100.0, 16).createOrReplaceTempView("test_tiles")
    cells.where("open").selectExpr("CAST(floor(r / 8) AS INT) AS br", "CAST(floor(c / 8) AS INT) AS bc", "r", "c").createOrReplaceTempView("test_blocks")
    walked = lambda where: spark.sql(f"SELECT * FROM walk_tiles(TABLE(SELECT * FROM test_tiles WHERE {where}) PARTITION BY (tr, tc), 4.5, 16)")
    labelled = lambda where: spark.sql(f"SELECT * FROM label_tiles(TABLE(SELECT * FROM test_blocks WHERE {where}) PARTITION BY (br, bc), true)")
    want = walk.walk_field(cells, F.col("target"), ~F.col("open"), 450.0, 100.0, tile=16).collect()
    firsts = {}
    for block in {(r // 8, c // 8) for r, c, _, _ in rows}:
        firsts |= _flooded({(r, c) for r, c, _, open_ in rows if open_ and (r // 8, c // 8) == block})
    for size in ("7", "200", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got, labels = walked("true").collect(), labelled("true").collect()
            assert walked("r > 99").collect() == labelled("r > 99").collect() == walked("NOT target").collect() == []
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((x.r, x.c, x.n_orth, x.n_diag) for x in got) == sorted((x.r, x.c, x.n_orth, x.n_diag) for x in want) and len(want) > 500
        assert all(abs(x.length - x.n_orth - x.n_diag * 2**0.5) < 1e-12 for x in got)
        assert {(x.r, x.c): (x.first_r, x.first_c) for x in labels} == firsts and len(labels) == len(firsts) > 500
    for df in (walked("true"), labelled("true")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan


def test_a_tile_walks_the_box_about_its_rows(monkeypatch):
    shapes = []
    monkeypatch.setattr(table_functions, "relaxed", lambda start, *a: shapes.append(start.shape) or walk.relaxed(start, *a))

    def tile_of(tr: int, tc: int, cells: list) -> list:
        work = table_functions.WalkTiles.func()
        for r, c, target in cells:
            row = {"tr": [tr], "tc": [tc], "r": [r], "c": [c], "target": [target], "open": [True]}
            work.eval(pa.RecordBatch.from_pydict(row), pa.array([2.0]), pa.array([256]))
        return [tuple(x.values()) for batch in work.terminate() for x in batch.to_pylist()]

    cells = [(r, c, (r, c) == (255, 1)) for r in range(254, 259) for c in range(3)]
    assert sorted(x[:2] for x in tile_of(1, 0, cells)) == [(256, 0), (256, 1), (256, 2), (257, 1)]
    assert tile_of(1, -1, cells) == [] == tile_of(0, 0, [(0, 0, False)]) and shapes == [(5, 3)]
