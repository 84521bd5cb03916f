"""The pipeline against plain Python, stage by stage on a small corpus."""

from __future__ import annotations

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from eventsort.llm import ngram_join
from eventsort.llm.store import new_path, write_table

from .conftest import frame, odd_texts, prose
from .test_counts_and_packing import PATH, check
from .test_text_operators import base_spans, chains, components, deduplicated, statistics, words

SECRET = "token = abcdef123456"


def corpus():
    rng = random.Random(11)
    texts = [(k, prose(rng, 90, 5000)) for k in range(30)]
    texts += [(100 + k, texts[k][1]) for k in range(5)]
    texts += [(200 + k, texts[k][1] + f" extra{k}") for k in range(5)]
    passage = prose(rng, 40, 9000)
    texts += [(300 + k, f"{prose(rng, 70, 5000)}\n{passage}\n{prose(rng, 5, 5000)} {SECRET} end") for k in range(6)]
    return texts + [(None if i is None else 400 + i, t) for i, t in odd_texts()]


def rows_of(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_stages(spark, tmp_path):
    texts = corpus()
    labels = str(tmp_path / "labels.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(labels)
    docs = frame(spark, texts)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = write_table(stages["quality_rules"](spark, docs, str(tmp_path)), new_path(spark, "t"))
    expected = [(i, t) for i, t in texts if (s := statistics(t))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert kept.columns == columns and rows_of(kept) == sorted((str(i), t) for i, t in expected)

    joined = write_table(stages["ngram_join"](spark, kept, str(tmp_path)), new_path(spark, "t"))
    heads = {i for i, _, c in components(expected) if i == c and i != "None"}
    texts_of: dict = {}
    for i, t in expected:
        texts_of.setdefault(str(i), []).append(t)
    got = rows_of(joined)
    assert joined.columns == columns and {i for i, _ in got if i != "None"} == heads and all(t in texts_of[i] for i, t in got)
    assert len([i for i, _ in got if i != "None"]) == len(heads)

    cut = write_table(stages["substring_dedup"](spark, joined, str(tmp_path)), new_path(spark, "t"))
    before = [(None if r["doc_id"] is None else r["doc_id"], r["text"]) for r in joined.collect()]
    judged = [x for x in deduplicated(before, 13) if not x[1] or x[2] < x[1]]
    assert cut.columns == columns and sorted((str(r["doc_id"]), len(words(r["text"]))) for r in cut.collect()) == sorted((i, n - gone) for i, n, gone, _ in judged)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    clean = write_table(stages["secret_scans"](spark, cut, str(tmp_path)), new_path(spark, "t"))
    assert clean.columns == columns and all(not base_spans(r["text"]) for r in clean.collect())
    assert sum("[SECRET]" in r["text"] for r in clean.collect()) == 6
    untouched = {str(r["doc_id"]): r["text"] for r in cut.collect() if not base_spans(r["text"])}
    assert {str(r["doc_id"]): r["text"] for r in clean.collect() if str(r["doc_id"]) in untouched} == untouched

    packed = stages["best_fit_packing"](spark, clean, str(tmp_path)).collect()
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    check(packed, left, Tokenizer.from_file(PATH), 1024)
    used = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= 1.05 * used / 1024 + 1


def test_runs_over_the_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "sequence_id" in found.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "substring_dedup", "secret_scans", "best_fit_packing"]
    assert not re.search(r"limit|sample", " ".join(corpus_pipeline.run.__code__.co_names))


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_ngram_join_goes_by_row(spark):
    rng = random.Random(5)
    a, b, c, d, e, f, g = (prose(rng, 80, 9000) for _ in range(7))
    rows = [(3, b), (5, a), (5, b + " near"), (6, c), (6, c), (6, d), (6, d.upper()), (8, c + " more"), (None, e), (None, e), (None, f), (9, f), (7, ""), (7, ""), (None, None), (10, g), (10, g + " tail")]
    docs = frame(spark, rows)
    got = rows_of(corpus_pipeline.ngram_join_stage(spark, docs, ""))
    sure = [(3, b), (5, a), (6, c), (None, e), (9, f), (7, ""), (7, ""), (None, None)]
    assert [x for x in got if x[0] != "10" and x[1].lower() != d] == sorted((str(i), t or "") for i, t in sure)
    assert [i for i, t in got if t.lower() == d] == ["6"] and [i for i, _ in got].count("10") == 1
    # however rows are dealt, the same ones stay
    assert rows_of(corpus_pipeline.ngram_join_stage(spark, docs.repartition(5).orderBy("text"), "")) == got


def test_ngram_join_of_large_blocks_keeps_one_row_of_a_chain(spark, monkeypatch):
    texts = chains(random.Random(3))
    heads = {i for i, _, c in components(texts) if i == c}
    for parts in (3, 3000):
        monkeypatch.setattr(ngram_join, "PART_SETS", parts)
        assert {i for i, _ in rows_of(corpus_pipeline.ngram_join_stage(spark, frame(spark, texts), ""))} == heads


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    nothing = jvm.java.util.ArrayList()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), nothing)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_ngram_join_does_not_deal_out_the_texts_that_stay(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(k, prose(rng, 2000, 10**9)) for k in range(80)]
    texts += [(100, texts[3][1]), (101, texts[4][1] + " near"), (5, texts[5][1]), (102, None), (102, None)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    stay = sorted((str(i), t or "") for i, t in [*texts[:80], *texts[-2:]])
    for marks in (1 << 18, 1):  # with one word of marks, most rows share one with a row that goes
        monkeypatch.setattr(corpus_pipeline, "MARKS", marks)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            kept = corpus_pipeline.ngram_join_stage(spark, write_table(frame(spark, texts), new_path(spark, "t")), "")
            before = shuffled(spark)
            got = rows_of(write_table(kept, new_path(spark, "t")))
            moved = shuffled(spark) - before
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert got == stay
        if marks > 1:
            assert moved < 0.2 * sum(len(t or "") for _, t in texts)
