from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventsort.llm import chat, topk


def brute(rows, k):
    usable = [(i, [math.floor(256 * x) for x in map(float, np.float32(v))]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, own in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(own))
            out |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores[:k])}
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string, key long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 1, "x", 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(block)
    rows = [(k, rng.normal(0, 0.2, 8).tolist()) for k in range(400)]
    rows += [(400 + k, rows[50][1]) for k in range(30)] + [(430 + k, [0.0] * 8) for k in range(30)]
    rows += [(450, [float("nan")] * 8), (500, [float("inf")] + [0.0] * 7), (550, None), (600, [None] + [0.0] * 7), (None, [1.0] * 8), (650, [1.0, 2.0]), (651, [2.0, 2.0]), (700, [])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {x for x in brute(rows, 5)}
    assert len(got) == len(brute(rows, 5))


def test_a_floor_skips_and_stops():
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(0, 50, (3000, 6)))
    lists = topk.SortedLists(np.arange(3000), rows)
    queries = np.round(rng.normal(0, 50, (20, 6)))
    assert (lists.bounds(queries) >= (rows @ queries.T).max(0)).all()
    for q in queries:
        ids, scores = lists.top(q, -1, 5)
        for floor in (scores[-1], scores[2], scores[0] + 1):
            some, theirs = lists.top(q, -1, 5, floor)
            assert [(i, s) for i, s in zip(some, theirs, strict=True) if s >= floor] == [(i, s) for i, s in zip(ids, scores, strict=True) if s >= floor]


def test_many_equal_vectors(spark):
    """Of them a query can use k, and its own is not among these."""
    rows = [(k, [1.0, 0.5]) for k in range(130)] + [(7, [1.0, 0.5])] * 4 + [(500, [2.0, -1.0]), (501, [0.0, 0.0])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=6).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    expected = []
    for q, own in [(q, v) for q, v in rows if q % 50 == 0]:
        scores = sorted((-int(sum(256 * 256 * a * b for a, b in zip(own, v, strict=True))), i) for i, v in rows if i != q)
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:6])]
    assert found == sorted(expected)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e12, -3.0]), (1, [1e12, 5.0]), (2, [1e12, 6.0]), (3, [-1e12, 0.0]), (4, [3e37, 0.0])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=3).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 4]


def test_repeated_and_few_rows(spark):
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


def test_the_walk_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (4000, 4))
    rows[7] = 50
    lists = topk.SortedLists(np.arange(4000), rows)
    seen = []
    original = topk.np.lexsort
    try:
        topk.np.lexsort = lambda keys: (seen.append(len(keys[0])), original(keys))[1]
        assert lists.top(np.ones(4), -1, 1)[0].tolist() == [7]
    finally:
        topk.np.lexsort = original
    assert sum(seen) < 400


# --- chats ---

TURNS = "conv_id long, turn long, role string, text string, pid int, number long, rendered string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS)


def test_given_speakers_are_recovered(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_chats(rows).collect()
    assert len(got) == rows.count() and sum(r["role"] == r["given_role"] for r in got) >= 0.99 * len(got)


def test_markers_in_text_split_rows(spark):
    text = "System: be kind\nUser: hi there?\nmore of it\nAssistant: hello"
    got = sorted((r["part"], r["role"], r["rendered"]) for r in chat.format_chats(turns(spark, [(1, 0, None, text)])).collect())
    assert got == [(0, "system", "<|system|>\nbe kind<|end|>\n"), (1, "user", "<|user|>\nhi there?\nmore of it<|end|>\n"), (2, "assistant", "<|assistant|>\nhello<|end|>\n")]


def test_missing_speakers_come_from_the_surroundings(spark):
    rows = [(1, k, None if k in (3, 6) else ("user", "assistant")[k % 2], "short words") for k in range(10)]
    got = {r["turn"]: r["role"] for r in chat.format_chats(turns(spark, rows)).collect()}
    assert got == {k: ("user", "assistant")[k % 2] for k in range(10)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_long_conversations_span_tasks(spark, partitions):
    """The same roles however the rows are dealt: as by one Viterbi over all lines."""
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant", None, "", "odd", "system"]), rng.choice(["", "why?", "x" * 400, "User: a\nb", None, "one\ntwo"])) for k in range(400)]
    rows += [(c, k, None, "hm") for c in (0, 2, None) for k in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chat.format_chats(turns(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = [r for r in rows if r[0] == 1]
    lines = [chat._lines(t, s, k) for _, k, s, t in mine]
    path = iter(chat._viterbi([x for row in lines for x in row], None, None))
    expected = []
    for (_, turn, _, _), row in zip(mine, lines, strict=True):
        states = [next(path) for _ in row]
        cuts = [k for k in range(len(row)) if not k or states[k] != states[k - 1]]
        expected += [(turn, j, chat.ROLES[states[k]]) for j, k in enumerate(cuts)]
    assert sorted((r["turn"], r["part"], r["role"]) for r in found if r["conv_id"] == 1) == sorted(expected)
    assert sum(r["conv_id"] != 1 for r in found) == 9


def emission(line, speaker, first, turn, k):
    """Log probabilities of a line by role, written out."""
    marker = re.match(r"(?i)[\s\[<(*#|]*(system|user|human|assistant|customer|prompter|bot|ai|agent)[\s\])>*|]*:[ \t]*", line)
    given = {"user": 1, "human": 1, "assistant": 2, "system": 0}.get((speaker or "").strip().lower())
    if marker and given is not None and marker[1].lower() in ("customer", "prompter", "bot", "ai", "agent"):
        marker = None
    body = line[marker.end() :] if marker else line
    word = {"system": 0, "user": 1, "human": 1, "customer": 1, "prompter": 1}.get(marker[1].lower(), 2) if marker else None
    out = []
    for r in range(3):
        p = chat.LONG[r, (len(body) >= 60) + (len(body) >= 300)] + chat.ASKS[r, int(body.rstrip().endswith("?"))]
        for said in (word, given if first else None):
            if said is not None:
                p += chat.MARKED if said == r else chat.OTHER
        out.append(p + chat._nudge(turn, k)[r])
    return out, first or marker is not None


@pytest.mark.parametrize("seed", range(6))
def test_roles_are_the_likeliest_of_all_paths(spark, seed):
    """Against the scores of every path, without the operator's own lines or search."""
    rng = random.Random(seed)
    texts = ["", "why?", "x" * 70, "User: a\nb", "A: first point", "Context: the lake", "Agent: hi\nthen", "Assistant: yes", "z" * 310, None]
    rows = [(1, k, rng.choice(["user", "assistant", None, "odd", "system"]), rng.choice(texts)) for k in range(5)]
    found = sorted((r["turn"], r["part"], r["role"], r["n_lines"]) for r in chat.format_chats(turns(spark, rows)).collect())
    lines = [(t, k, *emission(x, s, not k, t, k)) for _, t, s, text in rows for k, x in enumerate((text or "").split("\n"))]
    best = max(
        itertools.product(range(3), repeat=len(lines)),
        key=lambda path: sum(lines[i][2][r] + (chat.START[r] if not i else (chat.TURN if lines[i][3] else chat.STAY)[path[i - 1], r]) for i, r in enumerate(path)),
    )
    expected: list = []
    for (turn, k, _, _), r in zip(lines, best, strict=True):
        if k and expected[-1][2] == chat.ROLES[r]:
            expected[-1][3] += 1
        else:
            expected.append([turn, expected[-1][1] + 1 if k else 0, chat.ROLES[r], 1])
    assert found == [tuple(x) for x in expected]


def test_nothing_but_accepted_markers_is_lost(spark):
    rng = random.Random(5)
    texts = ["A: first point\nB: second", "Context: the lake", "q: odd", "User: hello\nUser: again", "Customer: ACME\nmodel: T", "Note: x\n\nAssistant: ok", "plain", "Answer: 42"]
    rows = [(c, k, ("user", "assistant", None, "system")[rng.randrange(4)], rng.choice(texts)) for c in range(20) for k in range(6)]
    out = {}
    for r in sorted(chat.format_chats(turns(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["turn"], r["part"])):
        assert r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("<|end|>\n")
        out.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["rendered"][len(r["role"]) + 5 : -8].split("\n")))
    for c, k, _, text in rows:
        left = iter(text.split("\n"))
        for role, lines in out[c, k]:
            for j, line in enumerate(lines):
                whole = next(left)
                assert line == whole or (j == 0 and re.fullmatch(rf"(?i)({'|'.join(n for n, r in chat.NAMES.items() if r == role and n in chat.MARKERS + chat.LOOSE)}): ", whole[: len(whole) - len(line)]) and whole.endswith(line))
        assert next(left, None) is None
    kept = {r["rendered"] for r in chat.format_chats(turns(spark, [(1, 0, "user", "A: first point"), (1, 1, "user", "Context: the lake"), (1, 2, "user", "Customer: ACME")])).collect()}
    assert kept == {f"<|user|>\n{t}<|end|>\n" for t in ("A: first point", "Context: the lake", "Customer: ACME")}


def test_one_repeated_row_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE_ROWS", 50)
    got = chat.format_chats(turns(spark, [(1, 0, "user", "same")] * 900 + [(2, 0, None, "Agent: hi")])).collect()
    assert len(got) == 901 and {r["rendered"] for r in got} == {"<|user|>\nsame<|end|>\n", "<|assistant|>\nhi<|end|>\n"}


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "user", ""), (2, 0, "USER ", "y" * 200_000)]
    got = chat.format_chats(turns(spark, rows)).collect()
    assert len(got) == 4
    assert chat.format_chats(turns(spark, [])).count() == 0
