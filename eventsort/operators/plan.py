"""Where every file of every event goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVALID_DAYS, auto_folder, folder_part, is_document
from ..scratch import new_path, write_table
from .cluster import FILE_FIELDS
from .naming import name_destinations

# The columns of a written plan, in order.
PLAN_COLUMNS = (
    "cluster_id", "event_day", "cluster_confidence", "cluster_file_count", "day_cluster_count", "review_recommended", "proposed_bucket",
    "proposed_action", "timestamp_start", "timestamp_end", "source_path", "proposed_folder", "proposed_destination", "file_name",
    "effective_timestamp", "effective_timestamp_source", "effective_timestamp_confidence", "effective_timestamp_precision",
    "is_document", "is_duplicate_secondary", "hash_sha256",
)


def auto_approved(day: Column, confidence: Column, files: Column, day_clusters: Column) -> Column:
    """High confidence, or medium with three files or more and alone on its day; never without a day."""
    alone = (confidence == "medium") & (files >= 3) & (day_clusters == 1)
    return F.when(day.isin(*INVALID_DAYS), False).otherwise((confidence == "high") | alone)


def day_counts(events: DataFrame) -> DataFrame:
    """Adds day_cluster_count, from a table of days that is joined."""
    days = events.groupBy("event_day").agg(F.count(F.lit(1)).alias("day_cluster_count"))
    return events.join(days, "event_day")


def classify(rows: DataFrame, root: str) -> DataFrame:
    """Adds bucket, action, folder and review_recommended. First that holds: document,
    duplicate, no day, approved, else review."""
    safe = folder_part(F.col("cluster_id"))
    general = lambda kind: F.concat_ws("/", F.lit(root), F.lit("_GENERAL"), F.lit(kind), safe)
    place = lambda bucket, action, folder: F.struct(F.lit(bucket).alias("bucket"), F.lit(action).alias("action"), folder.alias("folder"))
    chosen = (
        F.when(F.col("is_document"), place("general", "general_document", general("_DOCUMENTS")))
        .when(F.col("is_duplicate_secondary"), place("general", "general_duplicate", general("_DUPLICATES")))
        .when(F.col("event_day").isin(*INVALID_DAYS), place("general", "general_unsorted", general("_UNSORTED")))
        .when(F.col("auto"), place("auto", "auto", auto_folder(root, F.col("event_day"), F.col("day_sequence"))))
        .otherwise(place("review", "review", F.concat(F.lit(f"{root}/_REVIEW/"), "event_day", F.lit("_"), "cluster_id")))
    )
    rows = rows.withColumn("__place", chosen)
    p = F.col("__place")
    return rows.withColumns({"proposed_bucket": p["bucket"], "proposed_action": p["action"], "proposed_folder": p["folder"], "review_recommended": p["bucket"] == "review"}).drop("__place")


def plan_rows(files: DataFrame, events: DataFrame, root: str) -> DataFrame:
    """``files``: clustered rows with is_duplicate_secondary; ``events``: their summaries."""
    e = day_counts(events).withColumn("auto", auto_approved(F.col("event_day"), F.col("cluster_confidence"), F.col("file_count"), F.col("day_cluster_count")))
    e = e.select("cluster_id", "cluster_confidence", F.col("file_count").alias("cluster_file_count"), "day_cluster_count", "timestamp_start", "timestamp_end", "auto")
    rows = files.join(e, "cluster_id").withColumns({"is_document": is_document(F.col("file_name")), "source_path": F.col("file_path")})
    return classify(rows, root)


def build(files: DataFrame, events: DataFrame, root: str) -> DataFrame:
    """The plan: ``PLAN_COLUMNS`` and seq, the plan's order: that of events and of files in
    them. Rows are written before they get names, since ranges are found by a look at them."""
    rows = plan_rows(files, events, root).select(*[c for c in PLAN_COLUMNS if c != "proposed_destination"], F.col("file_order").alias("seq"))
    return name_destinations(write_table(rows, new_path(files.sparkSession, "plan")), "seq").select(*PLAN_COLUMNS, "seq")


def from_records(events: DataFrame) -> DataFrame:
    """Rows (event columns, file columns, position) of stored event records."""
    keep = [c for c in events.columns if c != "files"]
    return events.select(*keep, F.posexplode("files").alias("position", "f")).select(*keep, "position", *[F.col(f"f.{c}").alias(c) for c in FILE_FIELDS])
