"""Quality rules: learned decision lists over native text statistics.

``statistics`` computes each text's counts with DataFrame expressions only, in
its own row. ``learn`` runs sequential covering on the driver over a bounded
sample of labelled rows' statistics: it grows a conjunction of thresholds by
information gain on two thirds of the sample, prunes it on the rest, keeps it if
it is precise enough there, takes away what it covers and goes on. ``verdict``
turns the list into one ordered conditional expression.

Cases: null and empty texts have no words and fail the base rule; unlabelled
rows are judged like others; without usable labels the list is empty and the
base rule alone decides; null ids and repeated rows stay; an empty table gives
an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that ``learn`` sees at most.
SAMPLE_ROWS = 6_000
#: Thresholds tried for each statistic, conditions in a rule, rules in a list.
THRESHOLDS, CONDITIONS, RULES = 24, 4, 16
#: Share of rejected rows that really are bad, and rows covered, that a rule needs on the pruning rows.
PRECISION, COVER = 0.97, 4

#: What rules may test, each a count by another: shares, so that a long text is not judged by its length.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "shout_share": ("n_shouts", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


_SPACE = " \t\n\x0b\f\r"


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, *carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper, n_shouts, n_digits), all counts long.

    Equal three-word windows are found by sorting their 64-bit hashes."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), *carry)
    names = rows.columns[2:]
    t = F.col("text")
    trimmed = F.btrim(t, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"\S"))
    only = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")).cast("long")
    first = rows.select("doc_id", *names, words.alias("words"), lines.alias("lines"), only("#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_upper"), only("!?").alias("n_shouts"), only("0-9").alias("n_digits"))

    w = F.col("words")
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    second = first.select("*", windows.alias("windows"), F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars")).drop("words")

    h = F.col("windows")
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    third = second.withColumn("placed", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    p = F.col("placed")
    again = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    n_repeat = F.when(p.isNotNull(), F.size(F.array_distinct(covered))).otherwise(F.lit(0)).cast("long")
    n_lines = F.size("lines").cast("long")
    n_dup = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    counts = F.struct("n_words", "word_chars", "n_symbols", n_dup.alias("n_dup_lines"), n_repeat.alias("n_repeat_words"), n_lines.alias("n_lines"), "n_upper", "n_shouts", "n_digits")
    # a generator of one row: filters on the counts stay above it, else the
    # optimiser would copy the expressions above into them, lambdas and all
    return third.select("doc_id", *names, F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self) -> Column:
        value = feature(self.feature)
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Sequence[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(values), rule, np.ones(n, bool))


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for feature, x in values.items():
            for threshold in np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    c = Condition(feature, above, float(threshold))
                    now = inside & c.holds(values)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def learn_from(values: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """The decision list for rows' statistics; ``prune``: the rows held back for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)

    def worth(rule: Rule) -> tuple[float, int]:
        got = _holds(rule, values, len(bad)) & left & prune
        p, n = (got & bad).sum(), (got & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0, int(p + n)

    while len(rules) < RULES:
        grow = left & ~prune
        if not (grow & bad).any():
            break
        rule = _grow({k: x[grow] for k, x in values.items()}, bad[grow])
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r)[0], -len(r)))
        score, cover = worth(rule)
        if cover < COVER or (score + 1) / 2 < PRECISION:
            break
        rules.append(rule)
        left &= ~_holds(rule, values, len(bad))
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most ``sample_rows`` labelled documents, chosen by hash of the id.

    ``labels``: doc_id and quality, 0 for bad. The sample's ids are bounded, so
    they are broadcast and no text moves; only its statistics reach the driver, one
    row for each id: where rows share an id, the one whose statistics hash least."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("rules"))
    chosen = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    judged = statistics(texts).join(F.broadcast(chosen), "doc_id").where(~base_failed())
    shares = [feature(k).alias(k) for k in FEATURES]
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("prune")), F.lit(3)).alias("part")
    seen = judged.select("doc_id", F.struct("quality", part, *shares).alias("seen"))
    rows = [r["seen"] for r in seen.groupBy("doc_id").agg(F.min_by("seen", F.struct(F.xxhash64("seen"), "seen")).alias("seen")).orderBy("doc_id").collect()]
    values = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn_from(values, np.array([r["quality"] == 0 for r in rows], bool), np.array([r["part"] == 0 for r in rows], bool))


def verdict(rules: Sequence[Rule]) -> Column:
    """True: keep. The first rule whose conditions all hold rejects."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: Sequence[Rule], carry: Sequence[Column] = ()) -> DataFrame:
    """Statistics of every row, with base_failed and kept."""
    return statistics(docs, carry=carry).select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
