from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, bucket int, label string, hashes binary, row string, length long, score double, spans string"


def frame(spark, rows):
    """documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, 1, "x", b"h", "r", 5, 0.5, "z") for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    """(doc_id, text): nulls, empties, one very long text, ties, repeated rows and ids."""
    rng = random.Random(1)
    base = prose(rng, 120)
    long = "\n".join(prose(rng, 40) for _ in range(1500))
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (5, base), (6, base), (6, base), (6, base + " tail"), (None, base), (None, None),
        (7, long), (8, long[:5000] + " changed " + long[5000:]), (9, "x" * 5000), (10, "é日本🙂 " * 30), (11, "a  b c d\x0be\x1cf"), (12, base.upper()), (13, "same words " * 200),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])
