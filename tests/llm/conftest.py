from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, mark int, a string, gid long, key string"


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(d, t, g, "s", len(t or ""), "x", 0.0, 1, "a", 2, "k") for d, t, g in rows], DOC)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "be", "lo", "ti", "ra", "né", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def odd_rows():
    """Null and empty texts, white space, a very long text, exact and near copies, repeated rows, null ids."""
    base = prose(1, 300)
    near = base.replace(" ", "  ", 3).replace("lo", "LO", 2) + " tail"
    return [
        (1, base, "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "fr"), (5, prose(5, 30_000), "en"), (6, base, "en"), (7, near, "fr"), (7, near, "fr"),
        (None, base, "en"), (8, "two words", None), (9, "Two\twords", "de"), (10, "one", "en"), (11, "漢字 😀 <|endoftext|> it's  \x00 ok", "fr"), (12, prose(12, 40) + base[200:420] + prose(13, 40), "en"),
        (13, "a" * 5000, "en"), (14, "123 456", "en"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return make_docs(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
