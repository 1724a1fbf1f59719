"""BPE encoding by dynamic programming over prefixes, and decoding.

A text is split by the vocabulary's pattern into pre-tokens. In a pre-token's
encoding, the last token of each prefix's own encoding is unique, and the
encoding of a prefix is that of a shorter prefix plus this last token. So
for every prefix, shortest first, the vocabulary's tokens that end there
(longest first, found in one pass over an automaton with suffix links) are
tried: token ``t`` is the last one if the pair of the last token of the prefix
before it and ``t`` is compatible, that is, merging the two tokens' bytes
together would again give exactly these two. Following the stored tokens
back from the end gives the ids.

Compatibility of a pair follows from the merges alone: no merge across the
border may come before the merges that build the tokens on either side. The
test undoes the later of the two tokens' last merges, step by step, and looks
whether the border's pair would have merged earlier.

Pre-tokens repeat much, so each worker keeps the ids of those it has seen in
a table with a bound; beyond it the table starts anew (results don't change).

Null and empty texts give no ids, hence the digest of nothing. Very long
texts are split into pre-tokens as any other; pre-tokens may have any length.
Equal rows give equal values. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from footgrid.llm.common import sha256_hex, texts_of
from footgrid.llm.tokens import DEFAULT_VOCABULARY, SPECIAL, vocabulary

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TABLE_BOUND = 1_200_000
PAIRS_BOUND = 1_000_000


class PrefixEncoder:
    """Ids of pre-tokens and texts for one vocabulary."""

    def __init__(self, name: str = DEFAULT_VOCABULARY, table_bound: int = TABLE_BOUND):
        import ahocorasick
        import regex
        from tokenizers import pre_tokenizers

        self.tokens, merges = vocabulary(name)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        id_of = {t: i for i, t in enumerate(self.tokens)}
        self.special = id_of.get(SPECIAL.encode())
        #: By a pair of ids: the rank of its merge. By a token: its rank (single bytes: below all) and its two parts.
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.rank = [-1] * len(self.tokens)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        for rank, (a, b) in enumerate(merges):
            pair, made = (id_of[a], id_of[b]), id_of[a + b]
            self.merge_rank[pair] = rank
            if self.parts[made] is None:
                self.rank[made], self.parts[made] = rank, pair
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            if i != self.special:
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        encoder, bound = self, table_bound

        class Table(dict):
            """Ids of pre-tokens as little-endian 32-bit integers."""

            def __missing__(self, word: str) -> bytes:
                if len(self) >= bound:
                    self.clear()
                ids = encoder.encode_word(word.encode())
                out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
                return out

        self.table = Table()

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are merged together."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= PAIRS_BOUND:
            self.pairs.clear()
        a, b = left, right
        # Merges of rank at or after `until` have not yet happened on the border when (a, b) meet.
        until = len(self.merge_rank)
        ok = True
        while True:
            across = self.merge_rank.get((a, b))
            if across is not None and across < until:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # Undo the later merge. Of two equal ranks the left one happened first, so the right one is undone.
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                # At the rank of b's own merge the scan reaches the border's pair before b's pair.
                until, b = rb + 1, self.parts[b][0]
        self.pairs[key] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[int] = []  # by prefix length - 1
        known, compatible, tokens = self.pairs.get, self.compatible, self.tokens
        done = 0
        for end, (size, token) in self.automaton.iter(word.decode("latin-1")):  # for each end, longest first
            if end < done:
                continue
            if size <= end:
                previous = last[end - size]
                ok = known(previous << 32 | token)
                if not (compatible(previous, token) if ok is None else ok):
                    continue
            last.append(token)
            done += 1
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(tokens[last[at]])
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens. From U+0530 on, libraries differ in the Unicode version
        whose letters and numbers they know, so there the reference one splits."""
        if not text.isascii() and max(text) >= "\u0530":
            return [text[a:b] for _, (a, b) in self.library(text)]
        return self.find(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get = self.table.__getitem__
        if SPECIAL not in text or self.special is None:
            return b"".join(map(get, self.split(text)))
        mark = struct.pack("<I", self.special)
        return mark.join(b"".join(map(get, self.split(part))) for part in text.split(SPECIAL))

    def decode(self, ids: bytes) -> str:
        """Text of such ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder(name: str = DEFAULT_VOCABULARY) -> PrefixEncoder:
    return PrefixEncoder(name)


def encoded_ids(docs: DataFrame, name: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        for batch in batches:
            ids = [own.encode(t) for t in texts_of(batch)]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def id_digests(docs: DataFrame, name: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to.

    The same encoder as in ``encoded_ids``; only digests leave the Python worker.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                ids = own.encode(text)
                rows.append((len(ids) // 4, sha256_hex(ids), sha256_hex(own.decode(ids).encode())))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
