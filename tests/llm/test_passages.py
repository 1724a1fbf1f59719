"""Repeated passages of words against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

from footgrid.llm.suffix_dedup import WORDS, without_repeats


def cleaned(texts):
    """The texts without the bytes of any 51 words that start elsewhere too."""
    places = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for t in texts]
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    out = []
    for t, at, w in zip(texts, places, words):
        data = (t or "").encode()
        keep = bytearray(b"\1" * len(data))
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                a, b = at[i][0], at[i + 50][1]
                keep[a:b] = bytes(b - a)
        out.append(None if t is None else bytes(c for c, k in zip(data, keep) if k).decode())
    return out


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(3)
    word = lambda n=8: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, n)))
    text = lambda n, m=8: " ".join(word(m) for _ in range(n))
    passages = [text(51), text(51, 1), text(52), text(50), text(63), text(200), "x" * 900 + " " + text(49)]
    assert len(passages[1].encode()) < 200
    texts = [text(rng.randint(0, 90)) + "\n" + q + " " + text(rng.randint(0, 90)) for q in passages for _ in range(3)]
    texts += [passages[0].replace(" ", "\n "), passages[2] + " " + passages[2], "same " * 70, text(600), "", None, "y" * 500, text(80)]
    texts += [texts[-1]]
    docs = spark.createDataFrame([(i, t, b"x", 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, t binary, doc int, kept string")
    assert without_repeats(docs, WORDS).columns == docs.columns
    got = {r.doc_id: r.text for r in without_repeats(docs, WORDS).collect()}
    want = cleaned(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want[0] != texts[0] and want[3] != texts[3] and want[9] == texts[9]
    assert without_repeats(docs.where("false"), WORDS).count() == 0
