"""Quality by line labels: Viterbi decoding of a linear-chain conditional random field.

The lines of a text that hold a word are a sequence; each is content or
boilerplate. A line's features are in bins (words, symbols, capitals, digits,
exclamation marks, mean word length, whether it repeats an earlier line, whether it
ends a sentence); the field has a weight for each bin and label, one for each pair of
labels in a row, and one for each first label. Viterbi decoding gives the likeliest
labels. The text's content share is the share of its words that lie in content
lines; a text is kept if its base rules hold and the share is at least ``LEAST_SHARE``.

The weights are learnt by gradient steps on the exact likelihood (forward and
backward sums). Lines of documents labelled good count as content, those of documents
labelled bad as boilerplate. Two pieces of up to ``SEQUENCE_LINES`` lines are laid end to end as one training
sequence, so that changes are seen. About ``SAMPLE_ROWS`` labelled documents, with all their lines, are
used (a documented bound: rows are taken by a hash of doc_id below a
cut-off); every document is decoded, whole.

Null and empty texts have no words and fail. Repeated rows get equal results. Null or other
quality labels are not used; without labels of both kinds every line is content. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footgrid.llm.common import encoded

SAMPLE_ROWS = 4000
SEQUENCE_LINES = 64
LEAST_SHARE = 0.5
STEPS = 200
RIDGE = 1e-3
SETTLED = 1e-3
SYMBOLS = b"#*$%&|<>"
#: Upper ends (exclusive) of the bins of each feature.
BINS = {
    "words": (2, 5, 10, 20, 50),
    "symbols": (1e-9, 0.02, 0.1),
    "capitals": (0.05, 0.3, 0.7),
    "digits": (1e-9, 0.05, 0.2),
    "exclamations": (1e-9, 0.02),
    "word_length": (3, 5, 7, 10),
    "repeats": (0.5,),
    "ends": (0.5,),
}
FIRST = np.cumsum([0, *(len(b) + 1 for b in BINS.values())])
N_BINS = int(FIRST[-1])
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(members)] = 1
    return table


#: By byte: space, symbol, capital, letter, digit, exclamation mark, start of a character.
CLASSES = np.stack([
    _class(b" \t\n\v\f\r"), _class(SYMBOLS), _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),
    _class(bytes(range(48, 58))), _class(b"!"), _class(bytes([*range(0x80), *range(0xC0, 256)])),
], axis=1)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) < size + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    windows, n = ids[: len(ids) - size + 1], len(ids) - size + 1
    for k in range(1, size):
        windows = np.unique(windows * len(number) + ids[k : k + n], return_inverse=True)[1]
    often = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(size):
        covered[k : k + n] |= often
    return int(covered.sum())


def measured(data: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Base counts of a text; bins of its lines that hold a word; words in each of them."""
    words = data.split()
    lines = data.split(b"\n")
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    seen: set[bytes] = set()
    again = np.zeros(len(lines), dtype=np.int64)
    counts = np.zeros(len(lines), dtype=np.int64)
    ends = np.zeros(len(lines), dtype=np.int64)
    for i, line in enumerate(lines):
        counts[i] = len(line.split())
        if counts[i]:
            again[i] = line in seen
            seen.add(line)
            ends[i] = line.rstrip()[-1:] in b".?"
    b = np.frombuffer(data + b"\n", dtype=np.uint8)
    by_line = np.add.reduceat(CLASSES[b], np.cumsum(sizes + 1) - sizes - 1, axis=0)
    by_line[:, 0] -= 1  # the breaks themselves
    by_line[:, 6] -= 1
    chars = by_line[:, 6] - by_line[:, 0]
    spaces = int(by_line[:, 0].sum())
    base = (len(words), int(by_line[:, 6].sum()) - spaces, int(by_line[:, 1].sum()), int(again.sum()), repeated_words(words))
    use = np.flatnonzero(counts)
    if not len(use):
        return base, np.zeros((0, len(BINS)), np.int64), counts[use]
    per_char = lambda k: by_line[use, k] / chars[use]
    values = (counts[use], per_char(1), by_line[use, 2] / np.maximum(1, by_line[use, 3]), per_char(4), per_char(5), chars[use] / counts[use], again[use], ends[use])
    bins = np.stack([np.searchsorted(edges, v, side="right") + at for v, edges, at in zip(values, BINS.values(), FIRST)], axis=1)
    return base, bins, counts[use]


class Field:
    """Weights: ``emit`` (bin, label), ``move`` (label, label), ``begin`` (label). Label 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """The likeliest labels; ties go to content."""
        scores = self.emit[bins].sum(axis=1).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = (b + e for b, e in zip(self.begin.tolist(), scores[0]))
        back: list[tuple[int, int]] = []
        for e0, e1 in scores[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b >= a, d >= c))
            s0, s1 = (b if b >= a else a) + e0, (d if d >= c else c) + e1
        out = [int(s1 >= s0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1])


class _Group:
    """Sequences of like lengths, padded to the longest."""

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        longest, n = max(len(y) for _, y in sequences), len(sequences)
        self.bins, self.labels, self.there = np.zeros((longest, n, len(BINS)), np.int64), np.zeros((longest, n), np.int64), np.zeros((longest, n), bool)
        for j, (x, y) in enumerate(sequences):
            self.bins[: len(y), j], self.labels[: len(y), j], self.there[: len(y), j] = x, y, True
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (self.labels[:-1][self.there[1:]], self.labels[1:][self.there[1:]]), 1)

    def gradient(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the likelihood's logarithm, by forward and backward sums; and that logarithm."""
        bins, labels, there = self.bins, self.labels, self.there
        e = emit[bins].sum(axis=2)
        forward, backward = np.zeros(e.shape), np.zeros(e.shape)
        forward[0] = begin + e[0]
        for t in range(1, len(e)):
            f = np.logaddexp(forward[t - 1, :, :1] + move[0], forward[t - 1, :, 1:] + move[1]) + e[t]
            forward[t] = np.where(there[t][:, None], f, forward[t - 1])
        for t in range(len(e) - 2, -1, -1):
            after = e[t + 1] + backward[t + 1]
            g = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            backward[t] = np.where(there[t + 1][:, None], g, backward[t + 1])
        norm = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        share = np.exp(forward + backward - norm[:, None])
        gold = np.eye(2)[labels]
        gap = np.where(there[..., None], gold - share, 0)
        g_emit = np.stack([sum(np.bincount(bins[..., k].ravel(), gap[..., c].ravel(), N_BINS) for k in range(len(BINS))) for c in (0, 1)], axis=1)
        pair = forward[:-1, :, :, None] + move + (e[1:] + backward[1:])[:, :, None, :] - norm[:, None, None]
        g_move = self.seen - np.exp(pair[there[1:]]).sum(axis=0)
        reached = (e * gold)[there].sum() + (self.seen * move).sum() + begin[labels[0]].sum() - norm.sum()
        return np.concatenate((g_emit.ravel(), g_move.ravel(), gap[0].sum(axis=0))), float(reached)


def fitted(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, ridge: float = RIDGE, settled: float = SETTLED) -> Field:
    """Maximum likelihood with a ridge, by steps scaled to each weight's past gradients, until five of
    them raise the logarithm of the likelihood by less than ``settled`` a line."""
    by_size: dict[int, list] = {}
    for x, y in sequences:
        by_size.setdefault(len(y).bit_length(), []).append((x, y))
    groups = [_Group(g) for _, g in sorted(by_size.items())]
    weights = np.zeros(2 * N_BINS + 6)
    past, total, reached = np.full(len(weights), 1e-8), sum(len(y) for _, y in sequences), []
    parts = lambda: [p.reshape(s) for p, s in zip(np.split(weights, (2 * N_BINS, 2 * N_BINS + 4)), ((N_BINS, 2), (2, 2), (2,)))]
    for _ in range(steps):
        found = [g.gradient(*parts()) for g in groups]
        gradient = sum(g for g, _ in found) / total - ridge * weights
        reached.append(sum(r for _, r in found) / total)
        if len(reached) > 5 and reached[-1] - reached[-6] < settled:
            break
        past += gradient**2
        weights = weights + 0.3 * gradient / np.sqrt(past)
    return Field(*parts())


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field learnt from a bounded sample of labelled documents."""
    usable = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = usable.count()
    cut = min(1 << 20, -(-sample_rows * (1 << 20) // max(1, n)))
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut
    sample = docs.select("doc_id", "text").where(taken).join(usable.where(taken), "doc_id")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(d)[1] for d in encoded(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array([x.astype("<i1").tobytes() for x in found], pa.binary())], ["doc_id", "quality", "bins"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(lines, "doc_id long, quality int, bins binary").collect())  # about sample_rows rows
    whole = [(q, np.frombuffer(b, dtype="<i1").reshape(-1, len(BINS)).astype(np.int64)) for _, q, b in rows]
    # Long documents are several sequences; no line is left out.
    by_label = [[x[at : at + SEQUENCE_LINES] for q, x in whole if q == c for at in range(0, len(x), SEQUENCE_LINES)] for c in (0, 1)]
    if not all(by_label):
        return Field(np.tile([0.0, 1.0], (N_BINS, 1)), np.zeros((2, 2)), np.zeros(2))
    random = np.random.default_rng(4)
    sequences = []
    # As many documents of either label; two by two, so that all four changes of label are seen.
    for c in (0, 1):
        for x in by_label[c]:
            other = int(random.integers(2))
            y = by_label[other][int(random.integers(len(by_label[other])))]
            sequences.append((np.concatenate((x, y)), np.repeat([c, other], [len(x), len(y)])))
    return fitted(sequences)


def line_quality(docs: DataFrame, field: Field, least_share: float = LEAST_SHARE) -> DataFrame:
    """Base counts, content share and verdict of every document."""
    emit, move, begin = field.emit, field.move, field.begin

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(emit, move, begin)
        fields = [x.split() for x in RESULT.split(", ")][1:]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        for batch in batches:
            rows = []
            for data in encoded(batch):
                base, bins, words = measured(data)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                share = float((own.decode(bins) * words).sum() / words.sum()) if len(words) else 0.0
                rows.append((*base, failed, share, not failed and share >= least_share))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields))], ["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(work, RESULT)
