"""Packing of token sequences by the sum-of-squares rule.

Every task packs the documents of its input partition, in order, as they
come (online). A document is its ids plus an end id. Full windows are cut off
its front; what is left is an item of fewer than ``window`` tokens. With
``N(h)`` the number of open windows filled up to level ``h``, the item goes
to the level (0: a new window) that makes the sum of ``N(h)**2`` smallest.
Putting an item of size ``s`` on level ``h`` changes the sum by::

    h = 0        :  2 N(s) + 1
    h + s = W    : -2 N(h) + 1
    otherwise    : -2 N(h) + 2 N(h + s) + 2

Only the level array (``window`` counts) and, for every level, a list of open
windows are held. At the end of a partition the open windows that are left
are drained: documents may be cut freely, so their pieces are laid end to end
and cut at ``window``. At most one window per partition stays padded.

No row is shuffled: a window never holds pieces from two input partitions,
and ``sequence_id`` is the partition's number times 2**40 plus a count.
A retried task reads the same rows in the same order, so it gives the same
sequences.

Null and empty texts are documents of one token (the end id). Equal and
repeated rows are packed one by one. Extra columns are not read. Longest
text: cut as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from footgrid.llm.common import texts_of
from footgrid.llm.tokens import DEFAULT_VOCABULARY, rank_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES_PER_PARTITION = 1 << 40


class LevelPacker:
    """Online packing of items below ``window`` by the sum-of-squares rule."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        #: open[h]: windows filled up to h, each a list of items.
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level that makes the sum of squares smallest; ties: the fullest."""
        n, w = self.count, self.window
        if size >= w:
            return 0
        change = 2 * (n[size:w] - n[: w - size]) + 2  # levels 0 .. w - size - 1
        change[0] = 2 * n[size] + 1
        held = n[: w - size] > 0
        held[0] = True
        change = np.where(held, change, np.iinfo(np.int64).max)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if n[w - size] and 1 - 2 * n[w - size] <= change[best]:
            return w - size
        return best

    def add(self, size: int, item) -> list | None:
        """Places an item; gives the window's items if that has filled it."""
        h = self.level_for(size)
        items = []
        if h:
            items = self.open[h].pop()
            self.count[h] -= 1
        items.append(item)
        if h + size == self.window:
            return items
        self.open[h + size].append(items)
        self.count[h + size] += 1
        return None

    def rest(self) -> Iterator:
        """Items of all windows that are still open, fullest windows first."""
        for h in range(self.window, 0, -1):
            for items in self.open[h]:
                yield from items


def packed(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """A row for each piece: which ids of which document lie where in which sequence."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = rank_encoder(vocabulary), LevelPacker(window)
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        n_sequences, rows = 0, []

        def closed(items: list) -> None:
            """Writes the pieces of one window; an item: (doc_id, start, ids, doc_tokens)."""
            nonlocal n_sequences
            offset = 0
            for doc_id, start, ids, total in items:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + n_sequences, offset))
                offset += len(ids)
            n_sequences += 1

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.append(encode(text), end_id).astype("<u4")
                cut = len(ids) // window * window
                for start in range(0, cut, window):
                    closed([(doc_id, start, ids[start : start + window], len(ids))])
                if cut < len(ids):
                    full = packer.add(len(ids) - cut, (doc_id, cut, ids[cut:].copy(), len(ids)))
                    if full:
                        closed(full)
                if len(rows) > 20_000:
                    yield flushed()
        items, room = [], window
        for doc_id, start, ids, total in packer.rest():
            while len(ids) >= room:
                closed([*items, (doc_id, start, ids[:room], total)])
                start, ids, items, room = start + room, ids[room:], [], window
            if len(ids):
                items.append((doc_id, start, ids, total))
                room -= len(ids)
        if items:
            closed(items)
        yield flushed()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)
