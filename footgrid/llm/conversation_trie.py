"""Prefix trie of conversations.

Turns are ordered by their number (null first; ties: by a digest of role and text), null role or text
counting as empty. A conversation takes its first turns from the first one of its group of ``GROUP`` ids and goes on
with its own (``rebuilt``). Each distinct sequence of first turns is a node.

Conversations of equal turns are one path with a weight, so a hot group of copies is
one path. Their ids are hashed in order as a stream: sorted ranges are joined to chunks of text, and one hash reads
a node's chunks one after the other.

Paths are hash-partitioned by the digest of their first turn. A task builds pointer dictionaries for the
subtries of its bucket and goes through their nodes in postorder (a node is made after its parent, so the order of making, backwards, is
one), without recursion. A subtrie of more than ``OVERSIZED`` turns is cut first: the turns that all its
paths share become a trunk, and the paths are dealt again by their next turn, until each
part is small enough. Parts' sums then go up their trunks, cut by cut. A part of only one path has no branch to look up: its sums are
a running sum over its turns, whatever its length. So a group in a task is bounded, with nothing dropped.

A conversation's turns are numbered within ranges of (conversation, turn) and shifted by the counts of the
ranges before, so one with a third of all rows is spread as well.

Rows with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A conversation without turns
after rebuilding is a member of the root only. Very long texts are only digested and counted. Extra columns
are ignored. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from footgrid.llm.common import written

GROUP, MOST_HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a subtrie that one task builds at most, and of a bucket of subtries about.
OVERSIZED, BUCKET_ROWS = 512, 50_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "gid binary, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _digest(*parts: Column) -> Column:
    """16 bytes of SHA-256 of binary columns, one after the other."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``t`` (digest of role and text), ``words`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", t.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranges = written(turns.repartitionByRange(_parts(turns), "conv_id", "turn", "t").withColumn("part", F.spark_partition_id()), "turns")
    counts = ranges.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(W.partitionBy("conv_id").orderBy("part")) - F.col("count"))
    own = ranges.withColumn("rank", F.row_number().over(W.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "t")))
    return written(own.join(counts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("rank")).alias("pos"), "t", "words"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``size`` in turns) and their turns (``conv_id``, ``d`` from 1, ``t``, ``words``) once each has its head."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    convs = sizes.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = convs.join(base, "base", "left").withColumn("m", taken)
    convs = written(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = turns.where(F.col("pos") < MOST_HEAD).select(F.col("conv_id").alias("base"), "pos", "t", "words")
    heads = convs.select("conv_id", "base", "m").join(first, "base").where("pos <= m").select("conv_id", F.col("pos").alias("d"), "t", "words")
    tails = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "t", "words")
    return convs.select("conv_id", "size"), written(heads.union(tails), "rebuilt")


def hashed_ids(members: DataFrame) -> DataFrame:
    """``least`` and ``ends``, the SHA-256 of its ascending conv_ids joined by commas; ``members``: least, conv_id."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, ids = batch.column("least").to_pylist(), batch.column("conv_id").to_pylist()
            edges = [0, *(i for i in range(1, len(ids)) if group[i] != group[i - 1]), len(ids)]
            spans = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([group[a] for a, _ in spans], pa.int64()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())], ["least", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, hashlib.sha256()
        for batch in batches:
            done = []
            for group, ids in zip(batch.column("least").to_pylist(), batch.column("ids").to_pylist()):
                if group != held:
                    if held is not None:
                        done.append((held, running.hexdigest()))
                    held, running = group, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int64(), pa.string()))], ["least", "ends"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([running.hexdigest()])], ["least", "ends"])

    n = _parts(members)
    chunks = members.repartitionByRange(n, "least", "conv_id").sortWithinPartitions("least", "conv_id").mapInArrow(chunk, "least long, first long, ids string")
    return chunks.repartition(n, "least").sortWithinPartitions("least", "first").mapInArrow(digest, "least long, ends string")


def distinct_paths(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of turns: ``c`` (its smallest conv_id), ``n`` conversations, ``size``, ``gid`` (its first turn), ``ends``."""
    mixed = [F.bit_xor(F.xxhash64(*salt, "d", "t")).alias(x) for x, salt in (("x1", ()), ("x2", (F.lit(13),)))]
    whole = written(turns.groupBy("conv_id").agg(*mixed, F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("d") == 1, F.col("t"))).alias("gid")), "whole")
    kinds = ["x1", "x2", "size"]
    paths = written(whole.groupBy(*kinds).agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), F.min("gid").alias("gid")), "distinct")
    copies = whole.join(paths.where("n > 1").select(*kinds, F.col("c").alias("least")), kinds).select("least", "conv_id")
    ends = hashed_ids(copies).withColumnRenamed("least", "c")
    alone = F.sha2(F.col("c").cast("string").cast("binary"), 256)
    return written(paths.join(ends, "c", "left").select("c", "n", "size", "gid", F.coalesce("ends", alone).alias("ends")), "paths")


def subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of a bucket; rows: gid, c, d, t, words, n, ends (null but for a path's last turn)."""
    rows = rows.sort_values(["c", "d"], kind="stable")
    roots: dict[bytes, int] = {}
    pointers: list[dict[bytes, int]] = []
    gids, depth, parent, least, n_convs, words, ends = [], [], [], [], [], [], []

    def made(gid: bytes, d: int, up: int, c: int, w: int) -> int:
        for column, value in zip((pointers, gids, depth, parent, least, n_convs, words, ends), ({}, gid, d, up, c, 0, w, None)):
            column.append(value)
        return len(gids) - 1

    last, node = None, -1
    for gid, c, d, t, w, n, end in zip(*(rows[x].tolist() for x in ("gid", "c", "d", "t", "words", "n", "ends"))):
        if c != last:
            last, node = c, roots.get(gid, -1)
            if node < 0:
                node = roots[gid] = made(gid, d, -1, c, w)
        else:
            below = pointers[node].get(t)
            if below is None:
                below = pointers[node][t] = made(gid, d, node, c, w)
            node = below
        n_convs[node] += n
        if end is not None:
            ends[node] = end
    # Paths come by rising id, so the first to make a node is its smallest member. Backwards, children come before their parents.
    leaves = [0 if p else 1 for p in pointers]
    saved = [(n - 1) * w for n, w in zip(n_convs, words)]
    for i in range(len(gids) - 1, -1, -1):
        if (p := parent[i]) >= 0:
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    ups = pd.array([least[p] if p >= 0 else None for p in parent], dtype="Int64")
    return pd.DataFrame({"gid": gids, "top": [p < 0 for p in parent], "depth": depth, "conv_id": least, "parent_conv_id": ups, "n_convs": n_convs, "n_children": [len(p) for p in pointers], "n_leaves": leaves, "saved_tokens": saved, "ends": ends})


def _on_paths(turns: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """Turns of the members' paths from depth ``s`` of their subtrie on."""
    own = turns.withColumnRenamed("conv_id", "c").join(members.select("c", "s", *columns), "c")
    return own.where("d >= s").select("c", "d", "t", "words", "s", *columns)


def _small_nodes(turns: DataFrame, members: DataFrame, oversized: int, bucket_rows: int) -> DataFrame:
    """Nodes of subtries that are not cut; ``members``: paths with gid, s, ``rows`` of their subtrie."""
    total = members.agg(F.sum(F.col("size") - F.col("s") + 1)).first()[0] or 0
    buckets = max(_parts(turns), -(-total // bucket_rows))
    few = _on_paths(turns, members.where(F.col("rows") <= oversized), "gid", "n", "size", "ends")
    few = few.select("gid", "c", "d", "t", "words", "n", F.when(F.col("d") == F.col("size"), F.col("ends")).alias("ends"), F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"))
    built = few.groupBy("bucket").applyInPandas(lambda rows: subtries(rows), NODE)
    # What is left is one path each: a chain.
    long = _on_paths(turns, members.where(F.col("rows") > oversized), "gid", "n", "size", "ends")
    below = W.partitionBy("gid").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, 0)
    saved = F.sum((F.col("n") - 1) * F.col("words")).over(below)
    last, top = F.col("d") == F.col("size"), F.col("d") == F.col("s")
    chain = long.select("gid", top.alias("top"), F.col("d").alias("depth"), F.col("c").alias("conv_id"), F.when(~top, F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"))
    return built.unionByName(chain)


def trie(conversations: DataFrame, oversized: int = OVERSIZED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(numbered_turns(conversations))
    every = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()  # one row
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ends_sha256 string"
    if not every["n"]:
        return spark.createDataFrame([], schema)
    members = distinct_paths(turns).withColumn("s", F.lit(1).cast("long")).withColumn("parent", F.lit(None).cast("binary"))

    small: list[tuple[DataFrame, DataFrame]] = []  # nodes of the parts that are not cut, and the parent of each part, by cut
    trunks: list[DataFrame] = []
    while True:
        sizes = members.groupBy("gid").agg(F.sum(F.col("size") - F.col("s") + 1).alias("rows"), F.count(F.lit(1)).alias("paths"))
        members = written(members.join(sizes, "gid"), "members")
        cut = (F.col("rows") > oversized) & (F.col("paths") > 1)
        few = members.where(~cut)
        small.append((written(_small_nodes(turns, few, oversized, bucket_rows), "nodes"), few.select("gid", "parent").distinct()))
        large = members.where(cut)
        if large.isEmpty():
            break
        shared = _on_paths(turns, large, "gid", "paths").groupBy("gid", "d").agg(F.count(F.lit(1)).alias("have"), F.max("paths").alias("paths"), F.min("t").alias("t"), F.max("t").alias("other"), F.max("words").alias("words"))
        shared = written(shared, "shared")
        parted = shared.where("have < paths OR t <> other").groupBy("gid").agg((F.min("d") - 1).alias("last"))
        groups = large.join(parted, "gid")
        stem = groups.groupBy("gid").agg(F.first("parent").alias("parent"), F.first("s").alias("s"), F.first("last").alias("last"), F.sum("n").alias("n"), F.min("c").alias("c"), F.max(F.when(F.col("size") == F.col("last"), F.col("ends"))).alias("ends"))
        trunks.append(written(stem.join(shared.select("gid", "d", "words"), "gid").where("d <= last"), "trunks"))
        onward = groups.where("size > last").select("c", "n", "size", "ends", "gid", (F.col("last") + 1).alias("s"))
        onward = onward.join(turns.select(F.col("conv_id").alias("c"), F.col("d").alias("s"), "t"), ["c", "s"])
        members = written(onward.select("c", "n", "size", "ends", _digest("gid", "t").alias("gid"), "s", F.col("gid").alias("parent")), "onward")

    named = ["gid", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out, tops = [], None
    for level in range(len(small) - 1, -1, -1):
        nodes, parents = small[level]
        above = trunks[level - 1].groupBy("gid").agg(F.first("c").alias("up")) if level else None
        parts = nodes.join(parents.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g")).drop("g")
        if level < len(trunks):
            sums = tops.groupBy("parent").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"), F.count(F.lit(1)).alias("branches")).withColumnRenamed("parent", "gid")
            run = F.sum((F.col("n") - 1) * F.col("words")).over(W.partitionBy("gid").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, 0))
            top, end = F.col("d") == F.col("s"), F.col("d") == F.col("last")
            stem = trunks[level].join(sums, "gid").select("gid", "parent", top.alias("top"), F.col("d").alias("depth"), F.col("c").alias("conv_id"), F.when(~top, F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(end, F.col("branches")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (run + F.col("below")).alias("saved_tokens"), F.when(end, F.col("ends")).alias("ends"))
            parts = parts.unionByName(stem)
        up = F.lit(every["least"]).alias("up")
        parts = parts.join(above.withColumnRenamed("gid", "parent"), "parent", "left") if level else parts.withColumn("up", up)
        parts = written(parts.withColumn("parent_conv_id", F.when(F.col("top"), F.col("up")).otherwise(F.col("parent_conv_id"))).select(*named, "parent", "top"), "level")
        out.append(parts.select(*named[1:]))
        tops = parts.where("top").select("parent", "n_leaves", "saved_tokens")
    first = tops.agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()  # one row
    empty = hashed_ids(convs.where("size = 0").select(F.lit(0).cast("long").alias("least"), "conv_id")).first()  # one row at most
    root = spark.createDataFrame([(every["least"], 0, None, every["n"], first["n"], first["leaves"] or 1, first["saved"] or 0, empty["ends"] if empty else NOTHING)], schema)
    for part in out:
        root = root.unionByName(part.select(*COLUMNS, F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")))
    return root
