"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of one label and length are compared by cosine. A vector is scaled to length one and
rounded to integers of -127 .. 127 times a step of its own, ``u = s q + e``; the length of the
rest, ``|e|``, is computed in double precision. For two vectors::

    |u.v - s s' q.q'|  <=  |e| + |s q| |e'|

Rows are first grouped by their whole vector: copies are one node with a multiplicity, and link to each other
(a hot group of copies is one row from there on). A label's nodes are dealt to blocks of about ``BLOCK``; a block
is one packed row, and each pair of blocks of a label is a tile that one task multiplies. So a hot label
is many tiles, and a task holds two blocks whatever the label's size. In a tile ``q.q'`` is exact: products of integers
summed in single precision below 2**24, ``DIMS`` components at a time. A pair whose bounds
lie on one side of the threshold is decided by them; only what may be on either side is computed
again from the full vectors in double precision.

A tile emits, for each of its nodes with a link, how many vectors it links to there and one edge of a spanning
forest, never its pairs. Components are joined over all tiles by alternating stars. Every pair
of a label is compared: no candidate search, nothing is lost; work grows with the square of a label's distinct vectors, which
is the method's own price (a tile of 4096 by 4096 takes about 50 ms).

Links need equal labels that are not null. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and vectors of different lengths never link. Every row
is a vector: repeated rows link with each other, and rows of one vec_id with
different vectors are compared on their own. Rows with a null vec_id are compared too, but
name no component unless all its ids are null, and are never ``kept``. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footgrid.llm.common import written
from footgrid.operators.components import joined_labels

THRESHOLD = 0.93
BLOCK = 4096
STRIP = 512
#: 1024 products of at most 127**2 stay below 2**24.
DIMS = 1024
#: What double precision itself may lose, and single precision in the coarse test.
SLACK, COARSE = 1e-9, 1e-5
#: Pairs recomputed at once.
PAIRS = 1 << 14


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors of length over zero (rows, double): int8 rows, step, length of the rest and of ``s q``, the last two rounded up."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    u = vectors / top  # no square of a huge or tiny component over- or underflows
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    step = np.abs(u).max(axis=1) / 127
    q = np.rint(u / step[:, None])
    near = q * step[:, None]
    rest = np.sqrt(((u - near) ** 2).sum(axis=1)) + SLACK
    return q.astype(np.int8), step, rest, np.sqrt((near**2).sum(axis=1)) + SLACK


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, pair by pair, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class Block:
    """The nodes of a packed row."""

    FIELDS = (("node", "<i8"), ("n", "<i8"), ("step", "<f8"), ("rest", "<f8"), ("near", "<f8"))

    def __init__(self, row: dict, dims: int, kind: str):
        self.node, self.n, self.step, self.rest, self.near = (np.frombuffer(row[f], dtype=k) for f, k in self.FIELDS)
        self.q = np.frombuffer(row["q"], dtype=np.int8).reshape(-1, dims)
        self.vectors = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, dims)


def tile_pairs(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked pairs of places in two blocks, strip by strip, and how many of them had to be computed again;
    of a block with itself, each pair once."""
    right = b.q.astype(np.float32)
    worst, step = float(b.rest.max()), b.step.astype(np.float32)
    for at in range(0, len(a.node), STRIP):
        q = a.q[at : at + STRIP].astype(np.float32)
        product = np.zeros((len(q), len(right)), np.float32 if q.shape[1] <= DIMS else np.float64)
        for d in range(0, q.shape[1], DIMS):
            product += q[:, d : d + DIMS] @ right[:, d : d + DIMS].T
        # A coarse test in single precision, by the worst rest of the block; then each pair's own bounds.
        own = slice(at, at + STRIP)
        least = (threshold - COARSE - a.rest[own] - a.near[own] * worst) / a.step[own]
        i, j = np.nonzero(product * step >= (least - COARSE * np.abs(least))[:, None])
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        value = product[i, j].astype(np.float64) * a.step[i + at] * b.step[j]
        i = i + at
        bound = a.rest[i] + a.near[i] * b.rest[j] + SLACK
        sure, open_ = value - bound >= threshold, np.flatnonzero((value + bound >= threshold) & (value - bound < threshold))
        for k in range(0, len(open_), PAIRS):
            part = open_[k : k + PAIRS]
            sure[part] = cosines(a.vectors[i[part]].astype(np.float64), b.vectors[j[part]].astype(np.float64)) >= threshold
        yield i[sure], j[sure], len(open_)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after links (i, j): hooks the larger of two roots to the smaller until no link joins two."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def tile_links(a: Block, b: Block | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, number of vectors linked to it in this tile, and the smallest place's node of its component here."""
    other = a if b is None else b
    shift = 0 if b is None else len(a.node)
    node, n = (a.node, a.n) if b is None else (np.concatenate((x, y)) for x, y in ((a.node, b.node), (a.n, b.n)))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for i, j, _ in tile_pairs(a, other, threshold, b is None):
        j = j + shift
        for x, y in ((i, j), (j, i)):
            links += np.bincount(x, n[y], len(node)).astype(np.int64)
        root = joined(root, i, j)
    some = np.flatnonzero(links)
    return node[some], links[some], node[root[some]]


def keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """``vec_id``, ``label``, ``dims``, ``key`` (128 bits of a digest of the vector; null: it links with nothing) and ``vector``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding").cast(pa.list_(pa.float32() if kind == "<f4" else pa.float64()))
            flat, ends = np.asarray(column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=kind) + 0.0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            keys, bodies, dims = [], [], []
            for label, a, b in zip(batch.column("label").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                v = flat[a:b]
                fit = label is not None and b > a and bool(np.isfinite(v).all()) and bool(v.any())
                body = v.tobytes() if fit else None
                keys.append(hashlib.blake2b(body, digest_size=16).digest() if fit else None)
                bodies.append(body)
                dims.append(b - a)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["vec_id", "label", "dims", "key", "vector"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    label = own.schema["label"].dataType.simpleString()
    return own.mapInArrow(work, f"vec_id long, label {label}, dims int, key binary, vector binary")


def _kind(vectors: DataFrame) -> str:
    of = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "<f8"


def packed_blocks(nodes: DataFrame, kind: str, block: int) -> DataFrame:
    """A row for each block of a label's nodes: their numbers, multiplicities, int8 forms, bounds and full vectors, packed."""
    sizes = nodes.groupBy("label", "dims").count().select("label", "dims", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    fields = [*(f for f, _ in Block.FIELDS), "q", "vectors"]

    def pack(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=kind).reshape(-1, dims)
        q, step, rest, near = quantised(vectors.astype(np.float64))
        values = [table["node"].to_numpy().astype("<i8"), table["n"].to_numpy().astype("<i8"), step, rest, near, q, vectors]
        return pa.table([*(table[c].slice(0, 1) for c in ("label", "dims", "blocks", "block")), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["label", "dims", "blocks", "block", *fields])

    label = nodes.schema["label"].dataType.simpleString()
    return dealt.groupBy("label", "dims", "block").applyInArrow(pack, f"label {label}, dims int, blocks int, block int, " + ", ".join(f"{f} binary" for f in fields))


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row; ``vectors``: vec_id, embedding, label."""
    kind = _kind(vectors)
    rows = written(keyed(vectors, kind), "vectors")
    found = rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.first("dims").alias("dims"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    # Numbered once they are written, so that a task that runs again gives no other numbers.
    nodes = written(written(found, "distinct").withColumn("node", F.monotonically_increasing_id()), "nodes")
    blocks = written(packed_blocks(nodes, kind, block), "blocks")
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def tile(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["block"])
        held = [Block(r, r["dims"], kind) for r in parts]
        if len(held) == 1 and parts[0]["i"] != parts[0]["j"]:  # no node was dealt to the other block
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "links", "root"])
        columns = tile_links(held[0], held[1] if len(held) > 1 else None, threshold)
        return pa.table([pa.array(c) for c in columns], names=["node", "links", "root"])

    links = written(tiles.groupBy("label", "dims", "i", "j").applyInArrow(tile, "node long, links long, root long"), "links")
    roots = written(joined_labels(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "label", "key", "n", "least").join(counts, "node", "left").join(roots, "node", "left")
    placed = written(placed.select("label", "key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), "least", F.coalesce("root", "node").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = placed.join(named, "root").select("label", "key", "n_links", F.col("component_id").alias("c"))
    out = rows.select("vec_id", "label", "key").join(by_key, ["label", "key"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("c")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
