"""Centroid clustering on distinct quantised vectors with weights.

A vector of exactly ``DIMS`` components, none null or non-finite, is turned into integers
``floor(SCALE * x)``, and rows of equal integers are grouped: Lloyd's rounds run over each distinct vector once, with
its multiplicity. A round is one pass: every task assigns its vectors to the nearest
centroid and adds up weighted integer sums by cluster, the tasks' sums are
added exactly (decimals), and the driver gets one row for each of the ``CLUSTERS`` centroids. The next
centroid is the exact floor of sum by count; an empty one stays. After the last round all
are assigned once more, and the assignment is joined back to the rows by the vector. Only the
centroids (``CLUSTERS`` times ``DIMS`` integers) are sent to the tasks; rounds read the distinct vectors, which stay
where they are; a hot vector is one row with a large weight.

The first centroids are the kept rows whose SHA-256 of ``1:<vec_id>`` is smallest (equal rows, or rows of equal
vec_id, count one by one, by their integers). Ties in distance go to the smaller number. Fewer than ``CLUSTERS`` kept rows
give as many centroids. Rows that aren't kept get no result; a null vec_id is clustered like any other, but starts no
centroid unless ids run out. Repeated rows get equal results. Components beyond two million (2**27 as integer) count as that
bound, so that a distance fits a long; sums over vectors that don't fit a long are an error of Spark's cast, not a wrong number. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footgrid.llm.common import written

CLUSTERS, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
MOST = 1 << 27
#: Components below this have squared distances that double precision holds exactly (64 * (2 * 2**22)**2 = 2**52).
EXACT = 1 << 22


def packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds them all, after a byte for the width: equal vectors, equal bytes."""
    top = int(np.abs(values).max(initial=0))
    width = 1 if top < 128 else 2 if top < 32768 else 4
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, dtype=f"<i{r[0]}", offset=1)
    return out


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``q``, the packed integers, of the rows that are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding").cast(pa.list_(pa.float64()))
            right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            column = column.take(pa.array(right))
            values = np.asarray(column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
            finite = np.isfinite(values).all(axis=1)
            # Clipped before the product too, so that a huge component doesn't overflow.
            cells = np.clip(np.floor(scale * np.clip(values[finite], -MOST, MOST)), -MOST, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(right[finite])), pa.array([packed(x) for x in cells], pa.binary())], ["vec_id", "q"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(work, "vec_id long, q binary")


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and its squared distance, exact."""
    if max(int(np.abs(values).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT:
        x, c = values.astype(np.float64), centroids.astype(np.float64)
        distance = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distance = np.stack([((values - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(values)), best]


def cluster_sums(nodes: DataFrame, centroids: np.ndarray) -> list:
    """Count and componentwise sums of each cluster that is not empty, by one pass over the distinct vectors."""
    dims = centroids.shape[1]
    names = [f"s{i}" for i in range(dims)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = unpacked(batch.column("q").to_pylist(), dims), batch.column("n").to_numpy(zero_copy_only=False)
            best, _ = nearest(values, centroids)
            rows = []
            for c in np.unique(best).tolist():
                own = best == c
                # Python's integers: no weight is so large that a sum runs over.
                fit = int(n[own].sum()) * max(1, int(np.abs(values[own]).max(initial=0))) < 1 << 62
                sums = (n[own] @ values[own]).tolist() if fit else [sum(int(a) * int(b) for a, b in zip(n[own], col)) for col in values[own].T]
                rows.append((c, int(n[own].sum()), *sums))
            cols = list(zip(*rows)) or [()] * (dims + 2)
            kinds = [pa.int32(), pa.int64(), *[pa.decimal128(38, 0)] * dims]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["cluster", "n", *names])

    sums = nodes.select("q", "n").mapInArrow(work, "cluster int, n long, " + ", ".join(f"{x} decimal(38,0)" for x in names))
    return sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect()  # a row for each centroid


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """A row for each kept row of ``vectors`` (vec_id, embedding): its cluster, squared distance, and its centroid's and all clusters' figures."""
    rows = written(quantised(vectors, dims, scale), "quantised")
    nodes = written(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "weighted")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "q").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = unpacked([bytes(r["q"]) for r in first], dims)
    for _ in range(rounds):
        new = centroids.copy()
        for r in cluster_sums(nodes, centroids):
            new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
        centroids = new

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(unpacked(batch.column("q").to_pylist(), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(best.astype(np.int32)), pa.array(distance)], ["q", "n", "cluster", "distance"])

    placed = written(nodes.mapInArrow(assign, "q binary, n long, cluster int, distance long"), "assigned")
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance")).alias("d")).collect()  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    stats = [(r["cluster"], int(r["d"]), digest[r["cluster"]]) for r in inertia]
    figures = rows.sparkSession.createDataFrame(stats, "cluster int, cluster_inertia long, centroid_sha256 string")
    # As many rows as there are centroids.
    by_vector = placed.join(F.broadcast(figures), "cluster").select("q", "cluster", "distance", "cluster_inertia", "centroid_sha256")
    total = F.lit(sum(r[1] for r in stats)).cast("long").alias("inertia")
    return rows.join(by_vector, "q").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")
