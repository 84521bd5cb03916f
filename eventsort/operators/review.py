"""Decisions that people write into names of review folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVALID_DAYS, auto_folder


def parse(folders: DataFrame) -> DataFrame:
    """Adds base_name, decision, cluster_id and status to rows with folder_name.

    Ids of four digits or more are read whole."""
    name = F.col("folder_name")
    decision = F.regexp_extract(name, r"^(.+)_([AG])$", 2)
    base = F.regexp_extract(name, r"^(.+)_([AG])$", 1)
    event = F.regexp_extract(base, r"(event-\d{4,})", 1)
    status = F.when(decision == "", "ignored_no_suffix").when(event == "", "ignored_no_cluster_id").otherwise("decided")
    none = lambda c: F.when(c != "", c)
    return folders.withColumns({"base_name": none(base), "decision": none(decision), "cluster_id": none(event), "status": status})


def route(folders: DataFrame, events: DataFrame, target_root: str, general_root: str, strict: bool = False) -> DataFrame:
    """Adds event_day and target_folder. ``events``: cluster_id, event_day, day_sequence;
    an unknown event has day ``missing``. ``strict``: only ``missing`` counts as no day."""
    known = events.select("cluster_id", F.col("event_day").alias("__day"), F.col("day_sequence").alias("__n"))
    rows = parse(folders).join(known, "cluster_id", "left")
    day = F.coalesce("__day", F.lit("missing"))
    no_day = day == "missing" if strict else day.isin(*INVALID_DAYS)
    unsorted = F.concat_ws("/", F.lit(target_root), F.lit("_GENERAL"), F.lit("_UNSORTED"), "cluster_id")
    approved = F.when(no_day, unsorted).otherwise(auto_folder(target_root, day, F.coalesce("__n", F.lit(1))))
    target = F.when(F.col("decision") == "A", approved).when(F.col("decision") == "G", F.concat_ws("/", F.lit(general_root), "base_name"))
    decided = F.col("status") == "decided"
    return rows.withColumns({"event_day": F.when(decided, day), "target_folder": F.when(decided, target)}).drop("__day", "__n")


def with_counts(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_count from a listing of files (folder_name, ...); folders without files have 0."""
    n = files.groupBy("folder_name").agg(F.count(F.lit(1)).alias("file_count"))
    return routed.join(n, "folder_name", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))
