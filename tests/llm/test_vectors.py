"""Vectors: links and components, and clusters, against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from footgrid.llm import embedding_tiles, weighted_lloyd

WIDE = "vec_id long, embedding array<{}>, label int, node long, root long, n long, key string, q string, cluster int, c int"


def vectors(dims=64):
    """Near copies just above and below the threshold, exact copies, chains, awkward rows."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for k in range(rng.integers(1, 9)):
            side = rng.normal(size=dims)
            side -= (side @ base) * base
            side /= np.linalg.norm(side)
            cos = [1.0, 0.99, 0.9301, 0.9299, 0.945, 0.915, 0.93 + 1e-6, 0.93 - 1e-6][k]
            v = (cos * base + math.sqrt(1 - cos * cos) * side) * 10.0 ** rng.integers(-3, 4)
            rows.append((len(rows), v.astype(np.float32).tolist(), int(g % 3)))
    one = rows[5][1]
    rows += [(1000 + i, one, rows[5][2]) for i in range(20)]  # copies
    rows += [(1100, one, 7), (1101, one, None), (1102, None, 1), (1103, [], 1), (1104, [0.0] * dims, 1), (1105, one[:-1] + [float("nan")], 1), (1106, one[:-1] + [None], 1)]
    rows += [(1107, one[:-1] + [float("inf")], 1), (1108, one[:8], rows[5][2]), (1109, one[:8], rows[5][2]), (1110, [-x for x in one], rows[5][2]), (1111, [1e30] * dims, 9), (1112, [2e-38] * dims, 9)]
    rows += [rows[0], rows[0], (None, one, rows[5][2]), (None, [3.0] + [0.0] * (dims - 1), 8), (1113, [3.0, -0.0] + [0.0] * (dims - 2), 8), (2000, one, 5), (2000, rows[9][1], 5)]
    return [(*r, 1, 2, 3, "k", "q", 4, 5) for r in rows]


def fit(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    x = [np.array(r[1], float) / np.abs(np.array(r[1], float)).max() if r[2] is not None and fit(r[1]) else None for r in rows]
    near = lambda i, j: x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and float(x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j]))) >= 0.93
    n = len(rows)
    links = [[j for j in range(n) if j != i and near(i, j)] for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return out


def order(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("block,kind", [(4096, "float"), (7, "float"), (1, "float"), (16, "double")])
def test_links_and_components(spark, block, kind):
    rows = vectors()
    got = embedding_tiles.similar_vectors(spark.createDataFrame(rows, WIDE.format(kind)).repartition(3), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(brute_links([(r[0], r[1], r[2]) for r in rows]), key=order)
    assert max(r[1] for r in want) > 20 and sum(r[1] == 0 for r in want) > 5
    assert sorted(map(tuple, got.collect()), key=order) == want
    if block == 4096:
        assert embedding_tiles.similar_vectors(spark.createDataFrame([], WIDE.format(kind))).count() == 0


@pytest.mark.parametrize("dims", [2, 64, 1500])
def test_bounds_hold_and_few_pairs_are_computed_again(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims)) * 10.0 ** rng.integers(-4, 5, (300, 1))
    x[100:200] = x[:100] + rng.normal(size=(100, dims)) * np.abs(x[:100]).mean(axis=1, keepdims=True) * rng.uniform(0, 0.6, (100, 1))
    q, step, rest, near = embedding_tiles.quantised(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact, rough = u @ u.T, (q.astype(int) @ q.T.astype(int)) * step[:, None] * step
    assert (np.abs(exact - rough) <= rest[:, None] + near[:, None] * rest + 1e-12).all()
    fields = {"node": np.arange(300), "n": np.ones(300, int), "step": step, "rest": rest, "near": near, "q": q, "vectors": x}
    block = embedding_tiles.Block({k: v.tobytes() for k, v in fields.items()}, dims, "<f8")
    found = list(embedding_tiles.tile_pairs(block, block, 0.93, True))
    got = {(i, j) for a, b, _ in found for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in zip(*np.nonzero(exact >= 0.93)) if i < j} and got
    assert dims < 64 or sum(n for *_, n in found) < 100


def brute_clusters(rows, k=16):
    kept = [(r[0], np.floor(64 * np.clip(np.array(r[1], float), -(2**27), 2**27)).clip(-(2**27), 2**27).astype(int).tolist()) for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), weighted_lloyd.packed(np.array(r[1]))))[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    place = lambda: [min((far(q, c), i) for i, c in enumerate(centroids)) for _, q in kept]
    for _ in range(3):
        at = place()
        for i in range(len(centroids)):
            own = [q for (_, q), (_, j) in zip(kept, at) if j == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    at = place()
    inside = lambda i: sum(d for d, j in at if j == i)
    return [(v, i, d, inside(i), sum(x for x, _ in at), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for (v, _), (d, i) in zip(kept, at)]


@pytest.mark.parametrize("huge", [False, True])
def test_clusters(spark, huge):
    rows = [r for r in vectors() if huge or r[1] is None or r[1] == [] or r[1][0] is None or abs(r[1][0]) < 1e20]
    table = spark.createDataFrame(rows, WIDE.format("float")).repartition(5)
    got = weighted_lloyd.clusters(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_clusters(rows), key=order)


def test_few_and_no_vectors_to_cluster(spark):
    rows = [(i, [float(i)] * 64, 1) for i in range(5)] + [(9, [1.0], 1), (10, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, weighted_lloyd.clusters(table).collect())) == sorted(brute_clusters(rows))
    assert weighted_lloyd.clusters(table.where("vec_id > 8")).count() == 0 and weighted_lloyd.clusters(table.where("false")).count() == 0
