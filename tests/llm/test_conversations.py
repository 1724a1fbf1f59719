"""The prefix trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from footgrid.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, t string, gid string, n long, c long, words long"


def conversations():
    """Hot first turns, copies, long chains, nulls, repeated and tied rows, ids without a base."""
    rnd = random.Random(9)
    word = lambda: rnd.choice(["a", "bé", "c\td", "e", "  ", ""])
    text = lambda: " ".join(word() for _ in range(rnd.randint(0, 4)))
    rows = []
    for c in [*range(0, 130), *range(200, 220), 345, -7, -20, 10**15]:
        for k in range(rnd.randint(1, 6)):
            rows.append((c, k if k or c % 9 else None, rnd.choice(["user", "bot", None]), "hot" if k == 0 and c % 3 == 0 else rnd.choice(["x", "y", None, text()])))
    shared = [(k, "user", f"long shared {k}") for k in range(30)]
    for c in range(400, 440):  # copies and near copies of a deep conversation
        rows += [(c, k, r, t) for k, r, t in shared[: 30 - c % 4 * 5]]
        rows += [(c, 100, "user", "z")] * (c % 2)
    rows += [(500, k, "bot", f"deep {k}") for k in range(300)]
    rows += [(501, 1, "a", "b"), (501, 1, "a", "b"), (501, 1, "b", "a"), (501, 1, "ab", ""), (None, 1, "a", "b"), (502, None, None, None), (502, None, None, "w " * 20_000)]
    return [(*r, 1, "t", "g", 2, 3, 4) for r in rows]


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path)))
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        words = len((p[-1][1] if p else "").encode().split())
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids[p])
    least = {p: min(c for c, _ in m) for p, m in nodes.items()}
    ends = {p: ",".join(map(str, sorted(c for c, n in m if n == len(p)))) for p, m in nodes.items()}
    return [(least[p], len(p), least[p[:-1]] if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p in nodes]


def order(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("oversized", [4096, 3])
def test_nodes(spark, oversized):
    rows = conversations()
    got = conversation_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), oversized)
    assert got.columns == [*conversation_trie.COLUMNS, "ends_sha256"]
    want = sorted(brute_trie(rows), key=order)
    assert sum(r[3] > 5 for r in want) > 20
    assert sorted(map(tuple, got.collect()), key=order) == want


def test_few_conversations(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "u", "only turn", 1, "t", "g", 2, 3, 4) for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20]
    assert sorted(map(tuple, conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=order) == brute_trie(rows)
    assert len(brute_trie(rows)) == 1
