"""Which plan rows to apply, and what applying them would do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rank

RANKS = {"low": 0, "medium": 1, "high": 2}


@dataclass(frozen=True)
class Selection:
    min_confidence: str = "high"
    only_auto_approved: bool = False
    cluster_ids: Sequence[str] = ()
    overwrite: bool = False


def chosen(plan: DataFrame, by: Selection) -> DataFrame:
    """Rows to apply. A confidence that is null or unknown ranks below all."""
    out = plan.where(rank(F.col("cluster_confidence"), -1) >= RANKS.get(by.min_confidence, -1))
    if by.only_auto_approved:
        out = out.where(~F.coalesce("review_recommended", F.lit(True)))
    if by.cluster_ids:
        out = out.where(F.col("cluster_id").isin(*by.cluster_ids))
    return out


def existing(source_size: Column, target_exists: Column, target_size: Column) -> Column:
    """missing, exists_same_size, exists_conflict, or exists_unknown where a size is not known."""
    return F.when(~target_exists, "missing").when(source_size.isNull() | target_size.isNull(), "exists_unknown").when(source_size == target_size, "exists_same_size").otherwise("exists_conflict")


def probe(plan: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_exists and existing, from two listings (path, size)."""
    s = sources.select(F.col("path").alias("source_path"), F.col("size").alias("__source"), F.lit(True).alias("__there"))
    t = targets.select(F.col("path").alias("proposed_destination"), F.col("size").alias("__target"), F.lit(True).alias("__taken"))
    rows = plan.join(s, "source_path", "left").join(t, "proposed_destination", "left")
    taken = F.coalesce("__taken", F.lit(False))
    return rows.withColumns({"source_exists": F.coalesce("__there", F.lit(False)), "existing": existing(F.col("__source"), taken, F.col("__target"))}).drop("__source", "__there", "__target", "__taken")


def dry_run(probed: DataFrame, by: Selection) -> DataFrame:
    """Adds outcome: what a run that copies would find."""
    held = F.lit(not by.overwrite)
    outcome = F.when(~F.col("source_exists"), "source_missing").when((F.col("existing") == "exists_same_size") & held, "skipped_existing").when((F.col("existing") == "exists_conflict") & held, "skipped_conflict").otherwise("dry_run_planned")
    return probed.withColumn("outcome", outcome)
