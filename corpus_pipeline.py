"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), with docs what the stage before kept, and
returns a DataFrame that is written and read again as the next one's docs. All but
the last return the columns of docs, whatever these are.

1. quality_rules: documents that the base rule or the learned list rejects go.
2. ngram_join: of each group of linked rows the one with the smallest id stays;
   null ids come last, and what the row holds decides between equal ids. Rows that
   share an id but have unrelated texts all stay, as do rows without words.
3. substring_dedup: words of passages that a document with a smaller id has go;
   documents that lose all their words go.
4. secret_scans: secrets are replaced by a mark.
5. best_fit_packing: tokens are packed into sequences; the rows are the pieces.

Cases, the same in every stage: a null text counts as empty, so it goes in the first
stage; texts are taken whole, however long; rows with a null id stay rows of their
own (substring_dedup neither compares nor cuts them); of rows that are equal, or near,
one stays, and which one does not depend on how rows are dealt; an empty table gives
an empty table. Other columns are carried along whatever their names, but for
``__row``, ``__key`` and ``__same``, which must not be taken; ``n_chars`` follows the text.

The rules are learned from labels, tokens come from a vocabulary file and
sequences from a fit, so SQL can't express the stages; tests compare them with
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsort.llm import ngram_join, packing, quality_rules, secrets, substring_dedup
from eventsort.llm.queries import vocabulary
from eventsort.llm.store import drop_table, new_path, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The row that a stage carries along, under a name that no operator uses.
ROW = "__row"
#: The hash of a row, likewise.
KEY = "__key"
#: Words of 64 bits, a power of two, that mark the rows ngram_join asks about; no more of them are broadcast.
MARKS = 1 << 18


def _whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def _with_text(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of ``docs`` from carried rows, with the new text and its length."""

    def column(name: str) -> Column:
        if name == "text":
            return F.when(F.col(f"{ROW}.text").isNotNull(), F.col("text")).alias("text")
        if name == "n_chars":
            return F.when(F.col(f"{ROW}.text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"{ROW}.`{name}`").alias(name)

    return done.select(*map(column, docs.columns))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned list keep, as they were. Texts of fewer
    than 50 words, null ones among them, go."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules.apply_rules(docs, rules, carry=[_whole_row(docs)])
    return judged.where("kept").select(f"{ROW}.*")


def _row_key(docs: DataFrame) -> Column:
    """A hash of the whole row: the same however rows are dealt, and rows with one key
    have one text. Maps have no hash."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias(KEY)


def _mark() -> tuple[Column, Column]:
    """Where a row's mark is among ``MARKS``: the number of a word, and one of its bits."""
    return F.shiftrightunsigned(KEY, 6).bitwiseAND(F.lit(MARKS - 1)), F.expr(f"shiftleft(1L, cast({KEY} & 63 as int))")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one, as it was: that of the smallest id, null last,
    then of the smallest hash of the row. Rows without words, and rows of one id with
    texts that are not linked, are no group.

    Texts are not dealt out to find the rows that go: marks of these rows' hashes are sent
    to all tasks, and only rows that share a mark with one of them are joined by hash."""
    members = ngram_join.members(docs, width=5, percent=75, carry=[_row_key(docs)])
    linked = members.where("label is not null")
    copies = linked.groupBy("label", "doc_id", KEY).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", KEY, "n"))
    heads = copies.groupBy("label").agg(first.alias("head")).select(f"head.{KEY}", "head.n")
    judged = linked.select(KEY).distinct().join(heads, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("n"))
    asked = write_table(judged.where("n != 1"), new_path(spark, "asked"))
    word, bit = _mark()
    marks = asked.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).select(F.struct("word", "bits").alias(ROW))
    marked = docs.select("*", _row_key(docs)).join(F.broadcast(marks), word == F.col(f"{ROW}.word"), "left")
    met = F.coalesce(F.col(f"{ROW}.bits").bitwiseAND(bit) != 0, F.lit(False))
    columns = [f"`{c}`" for c in docs.columns]
    doubtful = marked.where(met).select(KEY, *columns)
    kept = marked.where(~met).select(*columns).union(doubtful.join(asked, KEY, "left_anti").select(*columns))
    repeated = asked.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.union(doubtful.join(repeated, KEY, "left_semi").dropDuplicates(["doc_id", KEY]).select(*columns))
    return kept


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the words of passages that a smaller id has; a row that loses all its
    words goes, one that had none stays."""
    done = substring_dedup.deduplicate(docs.select("doc_id", "text", _whole_row(docs)), width=13, carry=[ROW])
    return _with_text(docs, done.where("n_removed = 0 or n_removed < n_words"))


def secret_scans_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with ``[SECRET]`` in place of secrets; texts without any are as they were."""
    return _with_text(docs, secrets.redact(secrets.scan(docs, carry=[_whole_row(docs)])))


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, with their places in sequences: a null text is a piece of
    its end token alone, equal rows are packed as often as they occur."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("ngram_join", ngram_join_stage),
    ("substring_dedup", substring_dedup_stage),
    ("secret_scans", secret_scans_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read
    again, and goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
