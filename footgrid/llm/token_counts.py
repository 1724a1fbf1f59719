"""Token counts of sections by the offsets of whole-document tokens.

A document is encoded once, whole. Its sections partition its text (default:
lines, a line's break belonging to it). The tokens' character spans, sorted
as they come, are joined to the sections' spans with one merge. A token that
crosses a section's boundary is allocated by ``RULE``: to the section that
holds most of its characters, the earlier one if two hold as many. So the
counts of a document's sections add up to its token count.

A token that holds only part of a character's bytes spans the whole character.

Null and empty texts have one empty section with no tokens. Repeated rows are
counted one by one. Extra columns are ignored; texts are never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from footgrid.llm.common import texts_of
from footgrid.llm.tokens import DEFAULT_VOCABULARY, rank_encoder, vocabulary

RULE = "most characters, then the earlier section"
SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"


@functools.lru_cache(maxsize=2)
def _lengths(name: str) -> np.ndarray:
    return np.array([len(t) for t in vocabulary(name)[0]], dtype=np.int64)


def token_spans(text: str, ids: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every token."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(_lengths(name)[ids])
    return char_of[ends - _lengths(name)[ids]], char_of[ends - 1] + 1


def line_ends(text: str) -> np.ndarray:
    """Ends (exclusive) of a text's lines, each with its break."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(codes == 10) + 1
    return ends if len(ends) and ends[-1] == len(codes) else np.append(ends, len(codes))


def allocated(start: np.ndarray, end: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token by ``RULE``, and whether it crosses a boundary."""
    first = np.searchsorted(section_ends, start, side="right")
    last = np.searchsorted(section_ends, end, side="left")
    owner = first.copy()
    bounds = np.concatenate(([0], section_ends))
    for i in np.flatnonzero(first != last):
        edges = np.clip(bounds[first[i] : last[i] + 2], start[i], end[i])
        owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return owner, first != last


def section_tokens(docs: DataFrame, sections=line_ends, name: str = DEFAULT_VOCABULARY) -> DataFrame:
    """A row for each section of each document: its span and its tokens.

    ``sections`` gives the sorted ends of a text's sections; the last is its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, columns = rank_encoder(name), [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in columns]
            for row, text in enumerate(texts_of(batch)):
                ends = np.asarray(sections(text), dtype=np.int64)
                ids = encode(text)
                n = len(ends)
                owner, crossing = allocated(*token_spans(text, ids, name), ends) if len(ids) else (np.zeros(0, int), np.zeros(0, bool))
                values = (np.full(n, row), np.arange(n), np.concatenate(([0], ends[:-1])), ends, np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n))
                for part, v in zip(parts, values):
                    part.append(v)
            rows, *counts = [pa.array(np.concatenate(p), pa.int64()) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(rows), *counts], columns)

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
