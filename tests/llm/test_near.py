"""Near copies by words against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from footgrid.llm import simhash_bits


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    """Ids that are the smallest of their component."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        union = len(sets[a]) + len(sets[b]) - both
        if (both / union if union else 1.0) >= 0.8:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if root[i] == i}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):  # similarities from about 0.97 down to below 0.6
            texts.append(" ".join(word() if rng.random() < share else w for w in words))
    head = " ".join(word() for _ in range(60))  # alike, but by less than 0.8
    texts += [head + " " + " ".join(word() for _ in range(25)) for _ in range(12)]
    texts += ["", None, " ", "one two", "One  TWO", "one three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


CLASHING = "doc_id long, text string, t string, node int, root string, doc string, tie int, first string, least int"


@pytest.mark.parametrize("limit", [1 << 21, 500])
def test_near_copies_go_and_clean_documents_stay(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(simhash_bits, "HUB_PAIRS", 2000 if limit > 500 else 2)
    monkeypatch.setattr(simhash_bits.similar_texts, "__defaults__", (5, 0.8, simhash_bits.RADIUS, limit))
    wide = [(i, t, *("x", 1, "r", "d", 2, "f", i)) for i, t in rows]
    other = (rows[3][0], "quite another text of the same id", "x", 1, "r", "d", 2, "f", 0)
    table = spark.createDataFrame([*wide, wide[0], wide[0], other, (None, rows[1][1], *wide[0][2:]), (None, "a text that has no id", *wide[0][2:])], CLASHING).repartition(5)
    out = simhash_bits.without_near_copies(table)
    assert out.columns == table.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    texts = dict(rows)
    want = [(i, texts[i]) for i in kept_by_brute_force(rows)] + [(other[0], other[1]), (None, "a text that has no id")]
    assert len(rows) - len(want) > 60
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(got, key=order) == sorted(want, key=order)
    assert simhash_bits.without_near_copies(table.where("false")).count() == 0


def test_lanes_within_any_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = np.concatenate((values, values ^ np.uint64(0b1011), values ^ np.uint64(0xFFFF << 20)))
    for radius in (0, 1, 2, 3, 16, 26, 31, 40):
        got = {(i, j) for i, near in simhash_bits.near_lanes(values, radius) for j in near.tolist()}
        assert got == {(i, j) for i in range(180) for j in range(i + 1, 180) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
