"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

Features are the n-grams of the lower-cased (A-Z) UTF-8 text with a space at
either end, hashed to ``2**BITS`` places, each present or not. From all labelled
training rows come, for each place, the numbers of toxic and of other documents
that hold it. The logarithm of the ratio of the two (smoothed) rates scales
the feature. A place whose two rates differ by less than ``LEAST_Z`` standard errors
says nothing about the label and is scaled to zero (a parameter of ``trained``, 0 for no cut). A text's
features are divided by the square root of their number, so that long texts don't gather chance matches. A logistic
regression with a ridge penalty, both labels weighing the same in all, is then fitted on the scaled features of a
sample of the training rows, of about ``sample_rows`` rows (a documented bound: rows are taken by a hash
of doc_id below a cut-off), and scores every whole text.

Null and empty texts have only the features of the two spaces and get a score too.
Equal texts get equal scores. Null doc_ids are scored, never trained on. Rows of the
label table with a null label, or without a document, are not used. With no
usable labels, or labels of one kind only, every score is the share of toxic labels (no
labels: 0). Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footgrid.llm.common import encoded, written

BITS = 18
SIZES = (3, 4, 5, 6)
LEAST_Z = 4.0
SMOOTHING = 1.0
SAMPLE_ROWS = 3000
RIDGE = 1e-2
STEPS = 120
#: Steps end where none of the gradient's parts is larger.
SETTLED = 1e-6
#: Brings a text of this many features to the weight of its bare sum.
FEATURES = 1000
#: Entries multiplied at once.
ENTRIES = 1 << 20
SLICE = 1 << 12
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def places(data: bytes, mark: np.ndarray) -> np.ndarray:
    """Places of a text's n-grams, each once. ``mark``: scratch of ``2**BITS`` integers."""
    b = np.frombuffer(b" " + data.lower() + b" ", dtype=np.uint8).astype(np.uint64)
    found = []
    gram, size = b, 1
    for n, salt in zip(SIZES, SALTS):
        while size < n and len(gram) > 1:
            gram = gram[:-1] | b[size:] << np.uint64(8 * size)
            size += 1
        if size == n:
            found.append(((gram * np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64)
    at = np.concatenate(found)
    turn = np.arange(len(at))
    mark[at] = turn
    return at[mark[at] == turn]


def held_out(doc_id="doc_id"):
    """Column: whether labels of this document must not be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents with each feature, and documents, by label: toxic and other."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, by_label, docs = np.zeros(1 << BITS, np.int64), np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for data, toxic in zip(encoded(batch), batch.column("toxic").to_pylist()):
                by_label[toxic][places(data, mark)] += 1
                docs[toxic] += 1
        if docs.any():
            at = list(range(0, 1 << BITS, SLICE))
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1]), pa.array([*(by_label[:, a : a + SLICE].astype("<i8").tobytes() for a in at), docs.astype("<i8").tobytes()])], ["at", "counts"])

    def added(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype="<i8") for x in rows["counts"])
        return pd.DataFrame({"at": [key[0]], "counts": [total.tobytes()]})

    slices = train.select("text", "toxic").mapInArrow(part, "at long, counts binary").groupBy("at").applyInPandas(added, "at long, counts binary")
    by_label, docs = np.zeros((2, 1 << BITS)), np.zeros(2)
    for at, counts in slices.collect():  # 2**BITS counts, whatever the input
        values = np.frombuffer(counts, dtype="<i8")
        if at < 0:
            docs[:] = values
        else:
            by_label[:, at : at + SLICE] = values.reshape(2, -1)
    return by_label[1], by_label[0], int(docs[1]), int(docs[0])


def log_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, least_z: float = LEAST_Z) -> np.ndarray:
    """Naive Bayes log-count ratio of each place; 0 where the rates hardly differ."""
    p, q = toxic / n_toxic, other / n_other
    pooled = (toxic + other) / (n_toxic + n_other)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_toxic + 1 / n_other))
    ratio = np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((other + SMOOTHING) / (n_other + 2 * SMOOTHING))
    return np.where(np.abs(p - q) / error >= least_z, ratio, 0.0)


def damped(n):
    """The factor of a text with ``n`` distinct features."""
    return np.sqrt(FEATURES / np.maximum(n, 1))


class Rows:
    """Texts as lists of places; products with vectors go through them in parts."""

    def __init__(self, rows: list[np.ndarray], factor: np.ndarray, scale: np.ndarray, of: np.ndarray):
        """``of``: the number of each place among those with a ratio. ``rows`` is emptied, so that one copy is held."""
        self.scale, self.n, self.factor, self.parts = scale, len(rows), factor, []
        held, size, first = [], 0, len(rows)
        while rows:
            held.append(of[rows.pop()])
            size += len(held[-1])
            if size >= ENTRIES or not rows:
                held.reverse()
                self.parts.append((first - len(held), first, np.concatenate(held), np.array([len(r) for r in held])))
                first, held, size = first - len(held), [], 0

    def times(self, v: np.ndarray) -> np.ndarray:
        w, out = self.scale * v, np.zeros(self.n)
        for a, b, col, count in self.parts:
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), count), w[col], b - a)
        return out * self.factor

    def gathered(self, g: np.ndarray) -> np.ndarray:
        out, g = np.zeros(len(self.scale)), g * self.factor
        for a, b, col, count in self.parts:
            out += np.bincount(col, np.repeat(g[a:b], count), len(out))
        return out * self.scale


def fitted(rows: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, ratios: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on present features scaled by ``ratios``, by accelerated gradient steps.

    ``rows``: places of each text with a ratio; ``sizes``: all its places."""
    used = np.flatnonzero(ratios)
    of = np.zeros(len(ratios), np.int32)
    of[used] = np.arange(len(used))
    n = len(rows)
    x = Rows(rows, damped(sizes), ratios[used], of)
    share = min(max(float(labels.mean()), 1 / (2 * n)), 1 - 1 / (2 * n))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    # The largest curvature, by power iteration, gives the step.
    v, curvature = np.ones(len(used)) / max(1.0, np.sqrt(len(used))), 0.0
    for _ in range(20):
        u = x.gathered(weight * x.times(v))
        curvature = float(np.sqrt((u * u).sum()))
        v = u / max(curvature, 1e-12)
    step = 1 / (1.1 * (curvature + 1) / 4 + ridge)
    w, b = np.zeros(len(used)), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = x.times(vw) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        gw, gb = x.gathered(g) + ridge * vw, g.sum()
        nw, nb, nt = vw - step * gw, vb - step * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
        if max(abs(gb), float(np.abs(gw).max(initial=0.0))) < SETTLED:
            break
    out = np.zeros(len(ratios))
    out[used] = w * ratios[used]
    return out, float(b)


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least_z: float = LEAST_Z) -> tuple[np.ndarray, float]:
    """Weights by place and intercept, learnt from the rows that are not held out."""
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    # Labels grow with the documents, so they are never broadcast.
    train = written(docs.select("doc_id", "text").where(~held_out()).join(marked.hint("merge"), "doc_id"), "train")
    toxic, other, n_toxic, n_other = _counts(train)
    none = np.zeros(1 << BITS)
    if not n_toxic or not n_other:
        share = min(max(n_toxic / max(1, n_toxic + n_other), 1e-9), 1 - 1e-9)
        return none, float(np.log(share / (1 - share)))
    ratios = log_ratios(toxic, other, n_toxic, n_other, least_z)
    cut = min(1 << 20, -(-sample_rows * (1 << 20) // (n_toxic + n_other)))
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, used = np.zeros(1 << BITS, np.int64), ratios != 0
        for batch in batches:
            held = [(len(at := places(d, mark)), at[used[at]].astype("<i4").tobytes()) for d in encoded(batch)]  # one text's places at a time
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())], ["toxic", "size", "places"])

    found: list[np.ndarray] = []
    kinds = []
    for toxic, size, held in sample.select("text", "toxic").mapInArrow(present, "toxic int, size int, places binary").toLocalIterator():  # about sample_rows rows
        found.append(np.frombuffer(held, dtype="<i4"))
        kinds.append((toxic, size))
    if not found:
        return none, 0.0
    return fitted(found, np.array([n for _, n in kinds]), np.array([t for t, _ in kinds], dtype=float), ratios)


def scored(docs: DataFrame, weights: np.ndarray, intercept: float, column: str = "score") -> DataFrame:
    """``docs`` with their scores in a new column at the end."""
    small = weights.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            # One text's places at a time: those of a whole batch would be hundreds of MB.
            z = np.array([float(small[at := places(d, mark)].sum(dtype=np.float64)) * float(damped(len(at))) for d in encoded(batch)]) + intercept
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, column])

    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {column} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(work, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with their own columns, whatever these are called."""
    column = "score"
    while column in (c.lower() for c in docs.columns):
        column += "_"
    out = scored(docs, *trained(docs, labels), column=column).where(F.col(column) < least)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every document."""
    model = trained(docs, labels)
    out = scored(docs.select("doc_id", "text"), *model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
