"""Counts for reports. All are partial aggregates before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_key


def by_extension(registry: DataFrame) -> DataFrame:
    return registry.groupBy("extension").agg(F.count(F.lit(1)).alias("files"))


def by_source(registry: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(F.col("created_at_source"), F.lit("")), F.lit("missing"))
    return registry.groupBy(source.alias("timestamp_source")).agg(F.count(F.lit(1)).alias("files"))


def by_date(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce(date_key(F.col("created_at")), F.lit("missing")).alias("date")).agg(F.count(F.lit(1)).alias("files"))


def quality(registry: DataFrame) -> DataFrame:
    embedded = F.coalesce(F.col("created_at_is_embedded"), F.lit(False))
    return registry.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(embedded).alias("embedded_capture_time_count"),
        F.count_if(~embedded).alias("filesystem_only_count"),
        F.count_if(F.col("has_gps")).alias("gps_count"),
        F.count_if(F.col("has_camera_metadata")).alias("camera_metadata_count"),
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """(counter, files): bucket_X and action_X in one pass."""
    name = F.explode(F.array(F.concat(F.lit("bucket_"), "proposed_bucket"), F.concat(F.lit("action_"), "proposed_action")))
    small = plan.groupBy("proposed_bucket", "proposed_action").agg(F.count(F.lit(1)).alias("n"))
    return small.select(name.alias("counter"), "n").groupBy("counter").agg(F.sum("n").alias("files"))


def clusters_per_bucket(plan: DataFrame) -> DataFrame:
    return plan.groupBy("proposed_bucket").agg(F.count_distinct("cluster_id").alias("clusters"))


def selection(selected: DataFrame) -> DataFrame:
    """Selected files by confidence, with the events they come from."""
    confidence = F.coalesce("cluster_confidence", F.lit("unknown")).alias("cluster_confidence")
    return selected.groupBy(confidence).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("cluster_id").alias("clusters"))


def outcomes(rows: DataFrame, column: str = "outcome") -> DataFrame:
    """(counter, n); a counter that nothing touched has no row."""
    return rows.groupBy(F.col(column).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
