"""The queries of this subpackage, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_nbest import encode

    return encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep_ids=False, n_best=5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, learn

    docs = _table(spark, sf_dir, "documents")
    rules = learn(docs, _table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents"), width=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import format_chats

    turns = format_chats(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "part", "given_role", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import KINDS, joined, scan

    spans = scan(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_nbest,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_quality_rules,
        op5_token_counts,
        op6_ngram_jaccard_join,
        op7_exact_top_k,
        op8_substring_dedup,
        op9_chat_formatting,
        op10_secret_scans,
    )
}

_WORDS_SQL = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') IF x <> '']"

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), docs AS (
  SELECT rid, doc_id, {_WORDS_SQL} AS words FROM texts
), sets AS (
  SELECT DISTINCT rid, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT rid, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT rid, count(*) AS n FROM sets GROUP BY rid
), pairs AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM sets a JOIN sets b ON a.gram = b.gram AND a.rid < b.rid GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y WHERE 100 * o >= 75 * (a.n + b.n - o)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT rid, rid AS goal FROM docs UNION SELECT r.rid, e.y FROM reach r JOIN edges e ON e.x = r.goal
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(g.doc_id) AS component_id
FROM docs d JOIN reach r ON r.rid = d.rid JOIN docs g ON g.rid = r.goal LEFT JOIN sizes s ON s.rid = d.rid GROUP BY d.rid, d.doc_id
""",
    "op8_substring_dedup": f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS words FROM documents
), grams AS (
  SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT rid, doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM docs WHERE len(words) >= 13)
), firsts AS (
  SELECT gram, min(doc_id) AS first_doc FROM grams GROUP BY gram
), gone AS (
  SELECT DISTINCT rid, i + k AS p FROM grams JOIN firsts USING (gram), range(13) offsets(k) WHERE first_doc < doc_id
), placed AS (
  SELECT rid, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM docs
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM placed ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
""",
    "op7_exact_top_k": """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), ints AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM usable
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY CAST(list_inner_product(q.v, c.v) AS BIGINT) DESC, c.vec_id) AS rank
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
