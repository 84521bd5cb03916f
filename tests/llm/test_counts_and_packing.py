from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventsort.llm import bytebpe, packing
from eventsort.llm.packing import best_fit, cuts, pack, plan
from eventsort.llm.token_counts import token_counts

from .conftest import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_odd_texts(spark, odd, library):
    rows = token_counts(odd, PATH).collect()
    expected = sorted((str(i), len((t or "").encode()), len(ids(library, t))) for i, t in odd_texts())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_counts_of_nothing(empty):
    assert token_counts(empty, PATH).count() == 0


TEXT = st.text(st.one_of(st.sampled_from(" \n\t'sdtmrelv.,!0129aZéß²½  ؀中🙂\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_and_ids_equal_the_library(text):
    bpe = bytebpe.load(PATH)
    found = bpe.library.encode(text, add_special_tokens=False).ids
    assert bpe.count(text) == len(found)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == found


def test_special_strings_are_one_token():
    bpe = bytebpe.load(PATH)
    text = "a <|endoftext|><|endoftext|> b<|endoftext|"
    assert bpe.count(text) == len(bpe.library.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_the_cache_is_bounded():
    made = bytebpe.Remembered(lambda w: len(w), entries=bytebpe.CACHE_CORE + 10)
    for k in range(bytebpe.CACHE_CORE + 500):
        assert made[str(k)] == len(str(k))
    assert len(made) <= bytebpe.CACHE_CORE + 10


def test_cuts():
    assert cuts(1, 1024) == [0] and cuts(1024, 1024) == [0] and cuts(1025, 1024) == [0, 1] and cuts(2048, 1024) == [0, 1024] and cuts(2500, 1024) == [0, 452, 1476]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plans_hold_exactly_the_pieces(histogram):
    made = plan(histogram, 64)
    used: dict[int, int] = {}
    for lengths, many in made:
        assert many > 0 and 0 < sum(lengths) <= 64
        for length in lengths:
            used[length] = used.get(length, 0) + many
    assert used == histogram


def test_plans_come_close_to_the_bound():
    rng = random.Random(2)
    histogram: dict[int, int] = {}
    for _ in range(20000):
        length = min(1024, int(rng.lognormvariate(5.5, 0.9)) + 1)
        histogram[length] = histogram.get(length, 0) + 1
    sequences = sum(many for _, many in plan(histogram, 1024))
    bound = -(-sum(length * n for length, n in histogram.items()) // 1024)
    assert sequences <= bound * 1.005 + 2


def test_best_fit_places_each_piece_once():
    counts = np.zeros(11, int)
    counts[[3, 4, 7]] = 5, 2, 3
    made = best_fit(counts, 10)
    assert sum(n for _, n in made) == 5 and all(sum(x) <= 10 for x, _ in made)


def check(rows, texts, library, capacity):
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    expected = []
    for i, t in texts:
        x = np.array([*ids(library, t), 2], "<u4")
        at = [*cuts(len(x), capacity), len(x)]
        expected += [(str(i), k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)


def test_packing_of_odd_texts(spark, odd, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rows = pack(odd, PATH, capacity=1024).collect()
    check(rows, odd_texts(), library, 1024)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


def test_packing_with_a_small_capacity(spark, odd, library):
    check(pack(odd, PATH, capacity=16, keep_ids=False).collect(), odd_texts(), library, 16)


def test_packing_of_nothing(empty):
    assert pack(empty, PATH).count() == 0
