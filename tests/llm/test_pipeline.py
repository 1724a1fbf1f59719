"""All five stages of the pipeline against brute force, over rows with clashing names, repeated and null ids."""

from __future__ import annotations

import random
import re
import struct
import zlib

import public_tokenizers
from test_near import kept_by_brute_force
from test_passages import cleaned
from test_texts import BASE, holds
from tokenizers import Tokenizer

import corpus_pipeline as p

COLUMNS = "doc_id long, text string, email string, ip int, s int, n int, base int, t string, kept string, doc int, score double, added string, n_chars long, node int, root int"


def redacted(text: str) -> str:
    spans = sorted((m.start(), m.end(), k) for k in BASE for m in re.finditer(BASE[k], text) if holds(k, m.group()))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out, at = out + text[at:a] + f"<{k.upper()}>", b
        at = max(at, b)
    return out + text[at:]


def test_rows_equal_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(51), text(80)]
    texts = [text(rnd.randint(60, 200)) for _ in range(150)]
    texts += [f"{text(70)} {x} {text(70)}" for x in shared for _ in range(3)]  # passages
    base = text(300).split()
    texts += [" ".join(word() if rnd.random() < 0.01 else w for w in base) for _ in range(6)]  # near copies
    texts += [f"mail {word()}@b.example.org or call +1 555 010 9999 {text(60)}" for _ in range(5)]
    texts += [f"you vile wretch vile wretch {text(60)}" for _ in range(60)]
    texts += ["", None, texts[3], texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, text(90)), rows[7], (None, text(75))]  # a repeated id, a repeated row, no id
    toxic = {i for i, t in rows if i is not None and t and "vile" in t}
    labels = [(i, int(i in toxic)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, t, "e", 1, 2, 3, 4, "t", "k", 5, 0.5, "a", len(t or ""), 6, 7) for i, t in rows], COLUMNS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))

    # What is left, stage by stage.
    rows = [(i, t) for i, t in rows if not t or "vile" not in t]
    kept = kept_by_brute_force([(k, t) for k, (_, t) in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))])
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    rows = [order[k] for k in sorted(kept)]
    clean = cleaned([t for _, t in rows])
    assert sum(a != b for a, (_, b) in zip(clean, rows)) >= 6
    rows = [(i, t if t is None else redacted(t)) for (i, _), t in zip(rows, clean)]
    assert sum("<EMAIL>" in (t or "") and "<PHONE>" in (t or "") for _, t in rows) == 5

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
    got = docs.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    assert all(r.email == "e" and r.score == 0.5 and r.n_chars == len(r.text or "") for r in got if r.text is not None)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if i is None else i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, t in rows for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]])
    pieces: dict = {}
    for r in p.packing(spark, docs, str(tmp_path)).collect():
        pieces.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    totals: dict = {}
    for i, n, _ in want:
        totals[i, n] = totals.get((i, n), 0) + n
    assert {k: sum(x[1] for x in v) for k, v in pieces.items()} == totals
    whole = {k: v[0][2] for k, v in pieces.items() if len(v) == 1}
    assert whole and all(whole[i, n] == crc for i, n, crc in want if (i, n) in whole)
