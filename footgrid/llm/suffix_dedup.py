"""Removal of repeated strings, by merging Burrows-Wheeler transforms of shards.

A text is a sequence of units: its bytes (``BYTES``: strings of 400) or its words (``WORDS``:
strings of 51, split at ASCII white space, whose kind and amount don't count). Every unit covered
by a string of ``length`` units that starts anywhere else too (in any text, its own
included) is removed, for words with the bytes between them; strings never cross texts and
are judged on the input. Equal texts are one text with a weight, and a
string is repeated if the weights of its starts add up to two or more.

Spreading the work. For each start of a string, the run of ``gram`` units of smallest hash
that begins among its first ``starts`` units is the string's anchor: it depends on the string
alone, so equal strings have equal anchors at equal distances. Consecutive
starts with one anchor are a record. All strings of a record hold the same
``length - starts + 1`` units from the anchor on, its core, whose hash is the
record's bucket. Only buckets that weigh two or more can hold a repeated string, so
counts of the buckets (added up before the shuffle) leave the candidates;
nothing is sampled. A candidate's segment is what its strings cover; equal
segments are added up. Where all segments of a bucket are equal, each of
its strings is an interval of the bucket's weight. The others meet by bucket.

In a task, segments of some whole buckets are dealt to shards. Each shard's
suffixes are sorted on their own, over symbols of ``block`` units, and give
the shard's transform: the symbol before each suffix, in suffix order. The
shards' transforms are then merged by iterative interleave refinement: the
vector that says from which shard each row of the merged order comes starts as one
block, and each round deals its rows, stably, by the symbols that the transforms
have before them. After h rounds it is right for prefixes of h symbols, and
a boundary first seen in round h tells the common prefix of its two rows.
No suffix is sorted again. After ``length / block`` rounds (or when no
boundary is new) the common prefixes give the intervals: successive rows that share
``length`` units. An interval of weight two or more is repeated.

A bucket whose segments are over ``bucket_units`` (a passage that very many texts continue
differently) is a hot key. It is cut, not skipped: its segments are texts of their own and go through the same steps
with the same anchors, but a core longer by the narrower range of
distances (``width``) that a record may hold, so strings that differ near the passage's ends
part. At width one a bucket holds one string, so the cuts end. Results don't depend on the limit.

Symbols and segments are identified by 64-bit hashes within a bucket, texts
by 128 bits of SHA-256.

Null and empty texts: no units. Texts shorter than ``length``: nothing is removed.
Repeated rows are copies of each other. A null doc_id is kept as a row. Extra
columns, whatever their names, are ignored by ``repeated_spans``, kept by ``without_repeats``. Empty table: no rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from footgrid.llm.common import cleared, leave, new_folder, sha256_hex, written


@dataclass(frozen=True)
class Unit:
    """Units of a string, of the places its anchor may take, of an anchor and of a symbol."""

    length: int
    starts: int
    gram: int
    block: int
    words: bool = False
    #: Units merged at once, and of a shard at most.
    batch: int = 1 << 20
    shard: int = 1 << 18

    def __post_init__(self):
        if self.length % self.block or self.length < 2 * self.block or self.starts & (self.starts - 1) or self.length < self.starts + self.gram:
            raise ValueError("length is a multiple of block, twice that at least, and at least starts + gram; starts is a power of two")

    @property
    def least_bytes(self) -> int:
        """Bytes of the shortest string."""
        return 2 * self.length - 1 if self.words else self.length

    def of(self, body: bytes) -> np.ndarray:
        """A text's units: bytes, or a hash of each word."""
        if self.words:
            return np.array([xxhash.xxh64_intdigest(w) for w in body.split()], dtype=np.uint64)
        return np.frombuffer(body, dtype=np.uint8)

    def stored(self, segment: bytes) -> np.ndarray:
        """The units of a segment as ``tobytes`` gave it."""
        return np.frombuffer(segment, dtype=np.uint64 if self.words else np.uint8)


BYTES = Unit(400, 256, 24, 100)
WORDS = Unit(51, 32, 4, 17, words=True, batch=1 << 18, shard=1 << 16)
#: Shards of a merge at least, where it has as many segments.
LEAST_SHARDS = 4
#: How much narrower the records of a hot bucket get each time.
NARROWER = 16
#: Windows hashed at once: their places fit the low 20 bits.
CHUNK = (1 << 19) - 1024
BUCKET_UNITS = 256 << 10
BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and a random value for each byte."""
    n = CHUNK + 2048
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(n, dtype=np.uint64)
        p[1:] = base
        out.append(np.multiply.accumulate(p))
    return out[0], out[1], np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of any substrings of a buffer of at most ``CHUNK`` windows."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse, table = _powers()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((table[data] if data.dtype == np.uint8 else data) * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mixed((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of a size."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def anchored(hashes: Hashes, row: np.ndarray, left: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start and anchor of each record in a buffer of texts laid end to end.
    ``row``: the text of each unit; ``left``: units of it from there on."""
    n = len(row) - unit.length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = hashes.all(unit.gram)[: n + unit.starts - 1]
    # The hash's high bits, then the place: the smallest is the leftmost of the smallest.
    best = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < unit.starts:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    anchor = np.where(left[:n] >= unit.length, (best & np.uint64(0xFFFFF)).astype(np.int64), -1)
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])) + 1
    lo = np.concatenate(([0], change))
    hi = np.concatenate((change, [n])) - 1
    keep = anchor[lo] >= 0
    return lo[keep], hi[keep], anchor[lo[keep]]


def dealt(hashes: Hashes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """The records' starts parted by their distance to the anchor, ``width`` distances to a part:
    index of the record, first and last start, hash of the core (the bucket) and of the segment."""
    first, last = (at - hi) // width, (at - lo) // width
    count = last - first + 1
    i = np.repeat(np.arange(len(lo)), count)
    part = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    core = at[i] - part * width
    lo, hi = np.maximum(lo[i], core - width + 1), np.minimum(hi[i], core)
    bucket = _mixed(hashes.of(core, length - width + 1) + part.astype(np.uint64) * np.uint64(BASE))
    return i, lo, hi, bucket, hashes.of(lo, hi - lo + length)


def buffers(texts: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' units laid end to end in buffers of bounded size; long ones in pieces that
    overlap by ``length - 1`` units. Each: units, row of each, units left, place in the text."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def laid():
        data = np.concatenate([p for _, _, p in held])
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.repeat(np.cumsum(sizes), sizes)
        place = np.arange(len(data))
        first = np.repeat(np.cumsum(sizes) - sizes - np.array([a for _, a, _ in held]), sizes)
        return data, np.repeat(np.array([r for r, _, _ in held]), sizes), ends - place, place - first

    for r, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK // 2):
            piece = text[at : at + CHUNK // 2 + length - 1]
            if len(piece) < length:
                continue
            if size and size + len(piece) > CHUNK:
                yield laid()
                held, size = [], 0
            held.append((r, at, piece))
            size += len(piece)
    if held:
        yield laid()


def merged_blocks(symbols: np.ndarray, before: np.ndarray, orders: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge of shards' transforms by interleave refinement.

    ``symbols``: each suffix's first symbol (0: it is empty); ``before``: the symbol
    before it (0: none); ``orders``: the suffixes of each shard in sorted order.
    Gives the suffixes in merged order and the common prefix,
    in symbols, of each with the suffix above it (at most ``rounds``)."""
    transform = np.concatenate([before[o] for o in orders])
    sizes = np.array([len(o) for o in orders])
    shard = np.repeat(np.arange(len(orders), dtype=np.uint16), sizes)
    empties = np.array([int((symbols[o] == 0).sum()) for o in orders])
    top = np.repeat(np.arange(len(orders), dtype=np.uint16), empties)
    block = np.zeros(len(shard), dtype=np.int32)
    common = np.full(len(shard), -1, dtype=np.int16)
    for h in range(rounds):
        # Row i of a shard in the interleave is row i of its transform.
        symbol = np.empty_like(transform)
        symbol[np.argsort(shard, kind="stable")] = transform
        rows = np.flatnonzero(symbol).astype(np.int32)
        rows = rows[np.argsort(symbol[rows], kind="stable")]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = np.diff(symbol[rows]) != 0
        new[1:] |= np.diff(block[rows]) != 0
        shard = np.concatenate((top, shard[rows]))
        block = np.concatenate((np.zeros(len(top), dtype=np.int32), np.cumsum(new, dtype=np.int32)))
        bounds = np.concatenate((np.zeros(len(top), dtype=bool), new))
        seen = int((common >= 0).sum())
        common[bounds & (common < 0)] = h
        if int((common >= 0).sum()) == seen and h:
            break
    common[common < 0] = rounds
    suffixes = np.empty(len(shard), dtype=np.int32)
    suffixes[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    return suffixes, common


def sorted_suffixes(symbols: np.ndarray, left: np.ndarray, stride: np.ndarray, rounds: int, block: int) -> np.ndarray:
    """Suffixes of one shard, sorted by their first ``rounds`` symbols (or more)
    by doubling. ``left``: units from each place to the end of its segment;
    ``stride``: how far on in the arrays the place one symbol later is."""
    rank, covered = symbols.astype(np.int64), 1
    while covered < rounds:
        follow = np.zeros_like(rank)
        inside = np.flatnonzero(left >= covered * block)
        follow[inside] = rank[inside + covered * stride[inside]]
        key = rank * (int(rank.max()) + 1) + follow
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, covered = new, 2 * covered
    return np.argsort(rank, kind="stable").astype(np.int32)


def repeated_in(segments: list[np.ndarray], owned: np.ndarray, weight: np.ndarray, unit: Unit, shard_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of units that repeated strings cover: segment, start and end of each.

    ``owned``: how many starts of each segment, from its first unit, are its own. A suffix
    is read in steps of ``block`` units, so where a segment owns fewer starts than
    that, only the places a whole number of steps after them are suffixes."""
    length, block = unit.length, unit.block
    sizes = np.array([len(s) + 1 for s in segments], dtype=np.int32)  # with the empty suffix at the end
    base = np.cumsum(sizes, dtype=np.int32) - sizes  # a task holds a few MB: places fit 32 bits
    total = int(sizes.sum())
    end = np.zeros(1, segments[0].dtype)
    data = np.concatenate([x for s in segments for x in (s, end)])
    stride = np.minimum(owned, block).astype(np.int32)
    place = np.arange(total, dtype=np.int32) - np.repeat(base, sizes)
    used = np.flatnonzero(place % block < np.repeat(stride, sizes)).astype(np.int32)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)[used]
    place, stride = place[used], stride[segment]
    left = sizes[segment] - 1 - place
    real = np.flatnonzero(left >= block)
    hashes = np.empty(len(real), dtype=np.uint64)
    for at in range(0, total, CHUNK):
        a, b = np.searchsorted(used[real], [at, at + CHUNK])
        if a < b:
            hashes[a:b] = Hashes(data[at : at + CHUNK + block]).all(block)[used[real[a:b]] - at]
    symbols = np.zeros(len(used), dtype=np.int32)
    symbols[real] = np.unique(hashes, return_inverse=True)[1] + 1
    before = np.zeros(len(used), dtype=np.int32)
    inner = np.flatnonzero(place >= block)
    before[inner] = symbols[inner - stride[inner]]
    del hashes, real, inner, used
    cut = np.searchsorted(segment, np.flatnonzero(np.diff(base // min(shard_units, -(-total // LEAST_SHARDS)))) + 1)
    edges = [0, *cut.tolist(), len(symbols)]
    rounds = length // block
    orders = [a + sorted_suffixes(symbols[a:b], left[a:b], stride[a:b], rounds, block) for a, b in zip(edges, edges[1:])]
    del left, stride
    suffixes, common = merged_blocks(symbols, before, orders, rounds)
    # An interval: successive suffixes whose common prefix is a whole string.
    interval = np.cumsum(common < rounds)
    weights = np.where(place < owned[segment], weight[segment], 0)[suffixes]
    repeated = (np.bincount(interval, weights)[interval] >= 2) & (weights > 0)
    starts = np.sort(suffixes[repeated])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (place[starts[1:]] - place[starts[:-1]] > length) | (segment[starts[1:]] != segment[starts[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return segment[starts[first]], place[starts[first]], place[starts[last]] + length


def _runs_of(unit: Unit, batch_units: int, shard_units: int):
    wide = 8 if unit.words else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            at, start, end = repeated_in([unit.stored(r[3]) for r in rows], np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), unit, shard_units)
            ids = np.array([r[:3] for r in rows], dtype=np.int64).reshape(-1, 3)[at]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip((*ids.T, start, end), kinds)], ["bucket", "segment_id", "shift", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segment_id", "shift", "segment", "owned", "n"))):
                if size >= batch_units and held[-1][0] != row[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // wide
        if held:
            yield done(held)

    return work


def _records_of(unit: Unit, width: int):
    """Records of texts, or, where anchors are known (``width`` below ``starts``), of a hot bucket's segments."""
    known = width < unit.starts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, bodies = batch.column("t"), batch.column("n"), batch.column("body").to_pylist()
            if known:
                owned, shift = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owned", "shift"))
            for data, row, left, place in buffers([unit.stored(b) if known else unit.of(b) for b in bodies], unit.length):
                hashes = Hashes(data)
                if known:
                    lo = np.flatnonzero(place == 0)
                    hi, at = lo + owned[row[lo]] - 1, lo + shift[row[lo]]
                else:
                    lo, hi, at = anchored(hashes, row, left, unit)
                i, lo, hi, bucket, segment = dealt(hashes, lo, hi, at, width, unit.length)
                rows = pa.array(row[lo])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), n.take(rows), pa.array(bucket.view(np.int64)), pa.array(place[lo].astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array((at[i] - lo).astype(np.int32)), pa.array(segment.view(np.int64))],
                    ["t", "n", "bucket", "lo", "owned", "shift", "segment_id"],
                )

    return work


def _cut(unit: Unit, known: bool):
    names = ("bucket", "segment_id", "shift", "owned", "n", "hot")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, rows in zip(batch.column("body").to_pylist(), batch.column("records").to_pylist()):
                units = unit.stored(body) if known else unit.of(body)
                pieces = [units[r["lo"] : r["lo"] + r["owned"] + unit.length - 1].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[x] for r in rows], k) for x, k in zip(names, kinds)), pa.array(pieces, pa.binary())], [*names, "segment"])

    return work


def text_id(column="text"):
    """Column: 128 bits of SHA-256 of a text's UTF-8; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary"), 256)), 1, 16)


@contextmanager
def distinct_texts(docs: DataFrame, least_bytes: int) -> Iterator[DataFrame]:
    """Texts that can hold a string, once each, with their number: a table in the
    shared folder bucketed by ``t``, so that joins on it don't move the texts again. It is dropped at the end."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = docs.where(F.octet_length("text") >= least_bytes).select(text_id().alias("t"), F.col("text").cast("binary").alias("body"))
    texts = long.groupBy("t").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    texts.write.option("path", new_folder(spark, "texts")).option("compression", "zstd").bucketBy(n, "t").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def repeated_starts(texts: DataFrame, unit: Unit, width: int = 0, bucket_units: int = BUCKET_UNITS, batch_units: int = 0, shard_units: int = 0) -> DataFrame:
    """``t``, ``start`` and ``end``: runs of units that repeated strings cover; runs of one text may overlap."""
    width, length = width or unit.starts, unit.length
    known = width < unit.starts
    own = ["t", "n", "body", *["shift", "owned"] * known]
    found = written(texts.select(*own).mapInArrow(_records_of(unit, width), "t binary, n long, bucket long, lo int, owned int, shift int, segment_id long"), "records")
    kind = F.struct("segment_id", "shift", "owned")
    often = found.groupBy("bucket").agg(F.sum("n").alias("all"), (F.min(kind) == F.max(kind)).alias("alike")).where(F.col("all") >= 2).select("bucket", "alike")
    # Written, so that the join below has a shuffle on either side and a hot bucket can be split.
    candidates = written(found.join(written(often, "often"), "bucket"), "candidates")
    whole = candidates.where("alike").select("t", F.col("lo").alias("start"), (F.col("lo") + F.col("owned") + (length - 1)).alias("end"))
    mixed = candidates.where("NOT alike")
    # One text for each segment; equal segments are added up.
    segment = written(mixed.groupBy("bucket", "segment_id", "shift", "owned").agg(F.sum("n").alias("n"), F.min(F.struct("t", "lo")).alias("at")), "distinct")
    hot = segment.groupBy("bucket").agg(F.sum(F.col("owned") + (length - 1)).alias("size")).where(F.col("size") > (bucket_units if width > 1 else 1 << 62)).select("bucket", F.lit(True).alias("hot"))
    marked = segment.join(hot, "bucket", "left").select("bucket", "segment_id", "shift", "owned", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "at")
    sources = marked.groupBy("at.t").agg(F.collect_list(F.struct("bucket", "segment_id", "shift", "owned", "n", "hot", "at.lo")).alias("records"))
    # Written, so that the merge below is dealt by its own shuffle, which nothing splits within a bucket.
    segments = texts.join(sources, "t").select("body", "records").mapInArrow(_cut(unit, known), "bucket long, segment_id long, shift int, owned int, n long, hot boolean, segment binary")
    segments = written(segments, "segments")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = segments.where("NOT hot").repartition(parts, "bucket").sortWithinPartitions("bucket")
    runs = usual.mapInArrow(_runs_of(unit, batch_units or unit.batch, shard_units or unit.shard), "bucket long, segment_id long, shift int, start int, end int")
    large = segments.where("hot")
    if not large.isEmpty():
        names = ("bucket", "segment_id", "shift")
        named = large.select(F.concat_ws(":", *names).cast("binary").alias("t"), "n", F.col("segment").alias("body"), "shift", "owned")
        again = repeated_starts(named, unit, max(1, width // NARROWER), bucket_units, batch_units, shard_units)
        name = F.split(F.col("t").cast("string"), ":")
        runs = runs.union(again.select(*[name[i].cast("int" if c == "shift" else "long").alias(c) for i, c in enumerate(names)], "start", "end"))
    runs = written(runs, "runs")
    places = mixed.select("t", "bucket", "segment_id", "shift", "lo").join(runs, ["bucket", "segment_id", "shift"])
    return whole.union(places.select("t", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end")))


def repeated_runs(texts: DataFrame, unit: Unit, **tuning) -> DataFrame:
    """``t`` and ``spans``: the runs of each text that has any, in order."""
    return repeated_starts(texts, unit, **tuning).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def united(starts: np.ndarray, ends: np.ndarray, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    """Union of runs (sorted by start); runs that only touch are one or two."""
    reach = np.maximum.accumulate(ends)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = starts[1:] > reach[:-1] if touching else starts[1:] >= reach[:-1]
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _united(pieces: list[dict], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    return united(np.array([p["start"] for p in pieces]), np.array([p["end"] for p in pieces]), not unit.words)


def word_places(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    data = np.frombuffer(body, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _kept(texts: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """What is left of the texts that have spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, body, pieces in zip(*(batch.column(c).to_pylist() for c in ("t", "body", "spans"))):
                start, end = _united(pieces, unit)
                if unit.words:
                    first, last = word_places(body)
                    start, end = first[start], last[end - 1]
                edges = [0, *np.stack((start, end), axis=1).ravel().tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((t, len(body) - len(kept), len(start), sha256_hex(kept), kept))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 5, kinds)], ["t", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(spans, "t").select("t", "body", "spans").mapInArrow(work, "t binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _counted(spans: DataFrame, unit: Unit) -> DataFrame:
    """Number and units of the texts' runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_united(p, unit) for p in batch.column("spans").to_pylist()]
            columns = [pa.array([len(a) for a, _ in runs], pa.int64()), pa.array([int((b - a).sum()) for a, b in runs], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("t"), *columns], ["t", "n_passages", "n_passage_words"])

    return spans.mapInArrow(work, "t binary, n_passages long, n_passage_words long")


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, passages: Unit = WORDS, **tuning) -> DataFrame:
    """For each document: bytes, bytes removed, maximal removed runs, digest of the rest; and the number and the
    words of its passages that repeat by ``passages``, which may be shorter than a string of ``unit``."""
    spark = docs.sparkSession
    with cleared(spark), distinct_texts(docs, min(unit.least_bytes, passages.least_bytes)) as texts:
        removed = leave(_kept(texts, repeated_runs(texts, unit, **tuning), unit).drop("kept"), "removed")
        counted = leave(_counted(repeated_runs(texts, passages, **tuning), passages), "passages")
    base = docs.select("doc_id", text_id().alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own_sha256"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passages", "n_passage_words")]
    # One join for the documents, whose copies share a key that it can split.
    found = written(removed.join(counted, "t", "full"), "found")
    return base.join(found, "t", "left").select("doc_id", "n_bytes", *counts[:2], F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"), *counts[2:])


def without_repeats(docs: DataFrame, unit: Unit = BYTES, **tuning) -> DataFrame:
    """The documents without what repeated strings cover; a character that a removed run cuts through goes whole."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(bodies, pa.string())], ["t", "kept"])

    with cleared(docs.sparkSession), distinct_texts(docs, unit.least_bytes) as texts:
        kept = _kept(texts, repeated_runs(texts, unit, **tuning), unit).select("t", "kept")
        kept = leave(kept.mapInArrow(clean, "t binary, kept string"), "kept")
    # The documents' own columns travel in one, so that none of their names can clash.
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    out = own.withColumn("t", text_id(F.col("doc.text"))).join(kept, "t", "left")
    return out.select(*[F.coalesce("kept", "doc.text").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
