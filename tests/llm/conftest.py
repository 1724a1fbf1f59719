from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, bucket string, t string, n int, root long, fp string, digest string"


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice(("an", "the", "on", "ti", "re", "é", "st")) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, exact and near copies, shared passages, personal data."""
    rnd = random.Random(5)
    shared, base = words(rnd, 120), words(rnd, 400)
    near = base.split(" ")
    near[200] = "changed"
    texts = [
        None, "", " \n\t", "a", "Two words", base, base, " ".join(near), words(rnd, 30) + " " + shared + " " + words(rnd, 50), words(rnd, 60) + " " + shared,
        "x" * 5000, words(rnd, 9000), "line one\nline one\n\nline two###\n" * 4, "mail a.b@c-d.example.org or 10.0.0.255, 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999.",
        "é" * 450 + "ü" * 450, "é" * 450 + "ü" * 450, "<|endoftext|>hello <|endoftext|>", "日本語のテキスト 123 \u0600 ok", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end',
    ]
    rows = [(i, t, None if i % 3 else "en", "s", None, 0.5, i, "b", "t", 1, 2, "f", "d") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, words(rnd, 200), *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()
