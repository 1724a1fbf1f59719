"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit where over half the XXH64 values of the text's word
shingles have it. Documents of one fingerprint are one node, with its smallest
id. Fingerprints of at most ``radius`` differing bits are linked.

Search: the 64 bits are cut into ``radius + 2`` bands. Two fingerprints within
the radius agree on at least two bands, so each goes to one bucket for each
pair of bands (for radius 2: six buckets, by 32 bits). Buckets of more than
``bucket_limit`` fingerprints are dealt again by sub-bands of the bits that are
left, where at least one of ``radius + 1`` agrees; so no link is lost, and a
bucket's size is bounded by the bits that are left and not by the input.

In a bucket, fingerprints are stored vertically: one word per bit, a lane per
fingerprint. A fingerprint is compared with a block of lanes at once: the planes
that differ from its bits are added up by carry-save counters (ones, twos, and
what has run over), and a block is abandoned once all its lanes are beyond
the radius. A bucket emits only a spanning forest of its links, one row for
each fingerprint at most; components are then joined over all buckets.

Texts alike by words (``similar_texts``): links are pairs whose sets of five-word shingles have a
Jaccard similarity of at least 0.8. Two fingerprints of such texts differ in ten bits on
average, so no bands of theirs bring them together: buckets come from ``BANDS`` groups of ``ROWS`` least
values of the shingle set under random maps instead. Two texts of similarity s share one with probability
1 - (1 - s**ROWS)**BANDS, so three pairs of a million are missed at 0.8, fewer above. In a bucket the fingerprints are compared bit-sliced
as above, within ``RADIUS``: first with the bucket's least node only, which costs a comparison a text, then, in
buckets of texts that are not all connected by then, with each other; large ones part by part, none left out. Those that are near are held
against each other's whole sets of shingles (hashes of 32 bits), and linked at 0.8. A bucket emits no pairs but a
forest of its links.

Null and empty texts have fingerprint zero and are linked like any other (``similar_texts``: texts
without a word are one); texts with fewer words than a shingle are one shingle. Whole texts count, and repeated
shingles count again (``similar_texts``: once). Repeated rows share a component. Rows whose doc_id is null
get a row too; they don't name a component unless all its ids are null. Extra columns are
ignored, and kept by ``without_near_copies`` whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from footgrid.llm.common import encoded, written
from footgrid.llm.suffix_dedup import text_id
from footgrid.operators.components import joined_labels

SEED = 42
LANES = 8192
BUCKET_LIMIT = 20_000
CHUNK = 1 << 15
#: Of 64 bits, for texts alike by 0.8: they differ in 10 on average, in more than this once in some ten million pairs.
RADIUS = 26
BANDS, ROWS = 24, 4
#: Shingles mapped at once; of a cell's part at most; pairs of a hub that one place compares.
SHINGLES, CELL_SHINGLES, HUB_PAIRS = 1 << 18, 1 << 21, 2000


def fingerprint(data: bytes, size: int = 3) -> int:
    """SimHash of a UTF-8 text's word shingles, as an unsigned integer."""
    words = data.lower().split()  # bytes: A-Z, and space and \\x09-\\x0d
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    for at in range(0, n, CHUNK):
        values = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(values, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes())


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(d, size) for d in encoded(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def _planes(values: np.ndarray) -> tuple[list[int], int]:
    """The fingerprints' bits stored vertically, an integer for each bit with a lane for each fingerprint; all lanes."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(len(values), 64)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed], (1 << len(values)) - 1


def within(own: list[int], planes: list[int], full: int, order, radius: int) -> int:
    """Lanes within ``radius`` of a fingerprint with the bits ``own``.

    Each lane has a counter, kept in bit planes too, that starts so far below its overflow that the bit after
    the radius overflows it. The block is abandoned once all lanes have."""
    size = radius.bit_length()
    short = (1 << size) - 1 - radius
    counter = [full if short >> k & 1 else 0 for k in range(size)]
    beyond = 0
    for b in order:
        carry = planes[b] ^ full if own[b] else planes[b]
        for k in range(size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if not carry:
                break
        else:
            beyond |= carry
            if beyond == full:
                return 0
    return full & ~beyond


def _lanes(mask: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").astype(bool)


def near_lanes(values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint that has any, the later ones within the radius."""
    m = len(values)
    bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(m, 64)
    blocks = [(at, *_planes(values[at : at + LANES])) for at in range(0, m, LANES)]
    varied = np.flatnonzero((bits != bits[:1]).any(axis=0)).tolist()
    for i in range(m):
        own, found = bits[i].tolist(), []
        for at, planes, full in blocks:
            if at + LANES <= i + 1:
                continue
            mask = within(own, planes, full, varied, radius)
            if at <= i:
                mask &= ~((1 << (i - at + 1)) - 1)
            if mask:
                found.append(at + np.flatnonzero(_lanes(mask, full.bit_length())))
        if found:
            yield i, np.concatenate(found)


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints (unsigned), as pairs."""
    root = list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, near in near_lanes(values, radius):
        for j in near.tolist():
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [(i, a) for i in range(len(values)) if (a := top(i)) != i]


def _band(fp, first: int, bits: int):
    return F.shiftrightunsigned(fp, 64 - first - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``parts`` bands."""
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def fingerprint_links(nodes: DataFrame, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in ``fp`` within ``radius``, a forest for each bucket."""
    fp, bands = F.col("fp"), _cuts(64, radius + 2)
    pairs = list(combinations(range(len(bands)), 2))
    left_over = {p: [b for i, band in enumerate(bands) if i not in p for b in range(band[0], band[0] + band[1])] for p in pairs}
    keys = [F.struct(F.lit(i).alias("pair"), F.shiftleft(_band(fp, *bands[p]), bands[q][1]).bitwiseOR(_band(fp, *bands[q])).alias("bits")) for i, (p, q) in enumerate(pairs)]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.bits")
    hot = dealt.groupBy("pair", "bits").count().where(F.col("count") > bucket_limit).select("pair", "bits", F.lit(True).alias("hot"))
    marked = dealt.join(hot, ["pair", "bits"], "left")

    def sub(pair: tuple[int, int]):
        """Sub-bands of the bits that a pair of bands leaves, each a key of its own."""
        rest = left_over[pair]
        out = []
        for n, (a, width) in enumerate(_cuts(len(rest), radius + 1)):
            value = F.lit(0).cast("long")
            for b in rest[a : a + width]:
                value = F.shiftleft(value, 1).bitwiseOR(_band(fp, b, 1))
            out.append(F.shiftleft(value, 2).bitwiseOR(F.lit(n)))
        return F.array(*out)

    again = F.lit(None).cast("array<long>")
    for i, p in enumerate(pairs):
        again = F.when(F.col("pair") == i, sub(p)).otherwise(again)
    keyed = marked.select("fp", "pair", "bits", F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come sorted, one after the other; one that a batch ends in goes on with the next."""
        names = ("pair", "bits", "sub", "fp")
        held = [np.zeros(0, np.int64)] * 4

        def of(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            n = len(cols[0])
            if not n:
                return
            changed = np.zeros(n, dtype=bool)
            changed[0] = True
            for c in cols[:3]:
                changed[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(changed), n)
            if not last:
                held = [c[starts[-2] :] for c in cols]
                starts = starts[:-1]
            a, b, fps = [], [], cols[3].view(np.uint64)
            for k in np.flatnonzero(np.diff(starts) > 1):
                group = fps[starts[k] : starts[k + 1]]
                for i, j in bucket_links(group, radius):
                    a.append(group[i])
                    b.append(group[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            cols = [np.concatenate((h, batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False))) for h, c in zip(held, names)]
            yield from of(cols, False)
        yield from of(held, True)

    n = nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return keyed.repartition(int(n), "pair", "bits", "sub").sortWithinPartitions("pair", "bits", "sub", "fp").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id`` (smallest doc_id reachable)."""
    own = written(fingerprints(docs, size), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(joined_labels(fingerprint_links(nodes.select("fp"), radius, bucket_limit)), "roots")
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_values(data: bytes, size: int) -> np.ndarray:
    """Distinct hashes of a UTF-8 text's word shingles, in order; none if it has no word."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two results of ``shingle_values``; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A bucket for each band of each set (none empty)."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    values = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.stack([np.minimum.reduceat((values ^ s) * f, first) for f, s in zip(factors, shifts)], axis=1)
    return np.array([[xxhash.xxh64_intdigest(row[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)] for row in least], dtype=np.uint64)


def _majority(values: np.ndarray) -> int:
    """Fingerprint of a set of shingles."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(values)).tobytes())


def _sketches(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, same: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
            keys: list[list[int]] = [[]] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                for i, k in zip(full, _keys([sets[i] for i in full]).view(np.int64)):
                    keys[i] = k.tolist()
            fps = np.array([_majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
            columns = [pa.array(ids, pa.binary()), pa.array(same, pa.binary()), pa.array([len(s) for s in short], pa.int32()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["t", "node", "n", "fp", "keys", "set"])

        for batch in batches:
            ids, same, sets, held = [], [], [], 0
            for t, data in zip(batch.column("t").to_pylist(), encoded(batch)):
                ids.append(t)
                same.append(hashlib.sha256(b" ".join(data.lower().split())).digest()[:16])
                sets.append(shingle_values(data, size))
                held += len(sets[-1])
                if held >= SHINGLES:
                    yield done(ids, same, sets)
                    ids, same, sets, held = [], [], [], 0
            yield done(ids, same, sets)

    return work


def _near_first(radius: int):
    """Of rows with two fingerprints, those within the radius; a batch is one set of lanes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "first_fp"))
            near = np.concatenate([np.zeros(0, bool), *(_lanes(within([0] * 64, *_planes((x ^ y)[at : at + LANES]), range(64), radius), min(LANES, len(x) - at)) for at in range(0, len(x), LANES))])
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return work


def _set(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype=np.uint32)


def _near_pairs(radius: int, least: float):
    """Links of a bucket's cell between roots: a forest, so a link for each root at most.

    Fingerprints within the radius are held against each other's shingles, unless sizes rule ``least`` out or links have joined them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            node, fp, root, side, stored = list(zip(*rows))[2:]
            sets, sides = [_set(x) for x in stored], np.array(side)
            sizes = np.array([len(x) for x in sets])
            names = {r: i for i, r in enumerate(dict.fromkeys(root))}
            own, up, out = [names[r] for r in root], list(range(len(names))), []

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for i, j in near_lanes(np.array(fp, dtype=np.int64).view(np.uint64), radius):
                j = j[(np.minimum(sizes[j], sizes[i]) >= least * np.maximum(sizes[j], sizes[i])) & ((sides[j] != sides[i]) | (sides[i] == 0))]
                for k in j.tolist():
                    x, y = top(own[i]), top(own[k])
                    if x != y and jaccard(sets[i], sets[k]) >= least:
                        up[max(x, y)] = min(x, y)
                        out.append((node[i], node[k]))
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.binary()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "cell", "node", "fp", "root", "side", "set"))):
                if held and held[-1][:2] != row[:2]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return work


def _like_hub(least: float):
    """Links of hubs: a hub's row (``b`` is null) comes first, those to hold against it after it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint32)
        for batch in batches:
            out = []
            for a, b, stored in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set"))):
                if b is None:
                    hub = _set(stored)
                elif jaccard(hub, _set(stored)) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.binary()) for c in (0, 1)], ["a", "b"])

    return work


def _verified(stars: DataFrame, sets: DataFrame, least: float, parts: int) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough. A hub ``a`` of many pairs is dealt to several
    places, each of which gets its shingles once."""
    hubs = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("places"))
    none = F.lit(None).cast("binary")
    own = hubs.join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), none.alias("b"), "set")
    others = stars.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "places").cast("int").alias("place"), "b").join(sets, F.col("b") == F.col("node")).select("a", "place", "b", "set")
    return own.union(others).repartition(parts, "a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first()).mapInArrow(_like_hub(least), "a binary, b binary")


def similar_texts(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """``t`` (``text_id`` of each different text) and ``root``, the same for texts that links of at least ``least`` connect."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(text_id().alias("t"), "text").mapInArrow(_sketches(size), "t binary, node binary, n int, fp long, keys array<long>, set binary")
    own = written(own, "sketches")
    every = written(own.select("t", "node").distinct(), "every")
    sketches = own.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    dealt = written(sketches.select("node", "n", "fp", F.explode("keys").alias("k")), "dealt")
    shared = dealt.groupBy("k").agg(F.min(F.struct("node", "n", "fp")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    dealt = written(dealt.join(shared, "k"), "shared")
    fits = F.least("n", "first.n") >= least * F.greatest("n", "first.n")
    one = dealt.where(F.col("node") != F.col("first.node")).where(fits).select(F.col("first.node").alias("a"), F.col("node").alias("b"), "fp", F.col("first.fp").alias("first_fp")).dropDuplicates(["a", "b"])
    stars = written(one.mapInArrow(_near_first(radius), "a binary, b binary"), "stars")
    sets = written(own.select("node", "set").join(dealt.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = written(_verified(stars, sets, least, parts), "links")
    roots = written(joined_labels(links), "roots")
    placed = dealt.drop("first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Buckets that are one component by now are done.
    placed = written(placed, "placed")
    open_ = placed.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("size")).where("low < high").select("k", F.ceil(F.col("size") / cell_shingles).cast("int").alias("parts"))
    rest = placed.join(open_, "k").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # A large bucket is compared part by part: a cell for each two parts, and every node goes to the cells of its part.
    cells = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.shiftleft(F.least("part", "other").cast("long"), 32).bitwiseOR(F.greatest("part", "other").cast("long"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    cells = cells.select("k", cell.alias("cell"), "node", "fp", "root", side.alias("side")).join(sets, "node").select("k", "cell", "node", "fp", "root", "side", "set")
    more = cells.repartition(parts, "k", "cell").sortWithinPartitions("k", "cell").mapInArrow(_near_pairs(radius, least), "a binary, b binary")
    roots = written(joined_labels(links.union(written(more, "links"))), "roots")
    return every.join(roots, "node", "left").select("t", F.coalesce("root", "node").alias("root"))


def without_near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of similar texts: that with the smallest doc_id (null last), then the smallest
    ``text_id``, then the smallest digest of the other columns. Rows equal in all of them stay once."""
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    others = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = own.select("doc", text_id(F.col("doc.text")).alias("t"), F.sha2(F.to_json(F.struct(*others)) if others else F.lit(""), 256).alias("tie"))
    found = written(similar_texts(docs.select("text"), size, least), "similar")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t", "tie")
    first = rows.select("doc.doc_id", "t", "tie").join(found, "t").groupBy("root").agg(F.min(rank).alias("first")).select("first.*")
    left = rows.join(first.select("t", F.col("doc_id").alias("least"), F.col("tie").alias("its")), "t").where(F.col("doc.doc_id").eqNullSafe(F.col("least")) & (F.col("tie") == F.col("its")))
    return left.dropDuplicates(["t"]).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
