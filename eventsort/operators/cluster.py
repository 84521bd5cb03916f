"""Events by time gap.

Rows of a day in order of (instant, lower name, seq) belong to one event until
the gap to the row before exceeds what the lower of both confidences allows. A
day, an instant or a name may hold most of all rows, so rows are dealt by ranges of
that order (``positions``) and windows run over a day's share of a range: the last
row of each share tells the next one what came before, and the shares' event counts
give the offsets. Shares are no more than days and ranges together. Undated rows are
events of their own, on a day that sorts last. Rows are written once dealt and once
more with their flags, since several steps read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank
from ..scratch import new_path, write_table
from .enrich import TIME, event_day
from .positions import PART, ROW, dealt, running

# Hours that may lie between two rows of an event, by lower confidence.
GAP_HOURS = {"high": 4, "medium": 8, "low": 12}


def allowed_seconds(lower_rank: Column) -> Column:
    return F.when(lower_rank == 2, GAP_HOURS["high"] * 3600).when(lower_rank == 1, GAP_HOURS["medium"] * 3600).otherwise(GAP_HOURS["low"] * 3600)


def splits(before: Column, now: Column) -> Column:
    """Whether a row (struct epoch, rank, precision) begins an event after ``before`` of its day."""
    dated = (F.coalesce(before["precision"], F.lit("")) == "date") | (F.coalesce(now["precision"], F.lit("")) == "date")
    far = now["epoch"] - before["epoch"] > allowed_seconds(F.least(before["rank"], now["rank"]))
    return F.when(before.isNull(), 1).when(dated, 0).when(far, 1).otherwise(0)


def number_events(rows: DataFrame, point: Column, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Adds day_sequence (1 for the first event of a day), cluster_no (1 for the first
    event of all) and file_order (1 for the first row) to rows that have an event_day.

    ``point``: what ``splits`` looks at, null for rows without a time; ``order``: of a
    day's rows, telling them all apart; ``keys``: events never cross these columns."""
    day = [*keys, "event_day"]
    part = [*day, PART]
    names = [f"__by{k}" for k in range(len(order))]
    stored = dealt(rows.withColumns({"__point": point} | dict(zip(names, order, strict=True))), [*day, *names]).drop(*names)
    lasts = stored.groupBy(*part).agg(F.max_by("__point", ROW).alias("__last"))
    lasts = lasts.select(*part, F.lag("__last").over(Window.partitionBy(*day).orderBy(PART)).alias("__previous"))
    along = Window.partitionBy(*part).orderBy(ROW)
    fresh = F.when(F.col("__point").isNull(), 1).otherwise(splits(F.coalesce("__before", "__previous"), F.col("__point")))
    flagged = stored.withColumn("__before", F.lag("__point").over(along)).join(lasts, part).withColumn("__new", fresh)
    flagged = flagged.withColumn("__inside", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    events = write_table(flagged.drop("__point", "__before", "__previous", "__new"), new_path(rows.sparkSession, "events"))
    shares = events.groupBy(*part).agg(F.max("__inside").alias("__n"), F.count(F.lit(1)).alias("__rows"), F.min(ROW).alias("__first"))
    offsets = shares.select(*part, "__first", running("__n", [PART], day).alias("__earlier"), running("__n", part).alias("__events"), running("__rows", part).alias("__files"))
    number = lambda c: (F.col(c) + F.col("__inside")).cast("long")
    out = events.join(offsets, part).withColumns({"day_sequence": number("__earlier"), "cluster_no": number("__events"), "file_order": (F.col("__files") + F.col(ROW) - F.col("__first") + 1).cast("long")})
    return out.drop(PART, ROW, "__inside", "__first", "__earlier", "__events", "__files")


def cluster_id(number: Column) -> Column:
    return F.format_string("event-%04d", number)


def assign(enriched: DataFrame) -> DataFrame:
    """Adds event_day, day_sequence, cluster_no, cluster_id and file_order: events are
    numbered over all days, undated rows last."""
    epoch = F.col(f"{TIME}.epoch")
    point = F.struct(epoch.alias("epoch"), rank(F.col("effective_timestamp_confidence"), 0).alias("rank"), F.col("effective_timestamp_precision").alias("precision"))
    rows = enriched.withColumn("event_day", event_day(F.col(TIME)))  # ``missing`` sorts last
    numbered = number_events(rows, F.when(F.col(TIME).isNotNull(), point), (epoch, F.lower("file_name"), F.col("seq")))
    return numbered.withColumn("cluster_id", cluster_id(F.col("cluster_no")))


def confidence_of(rank_column: Column) -> Column:
    """A group's confidence from its rows' ranks, in whole tenths: high from 0.85, medium from 0.60."""
    tenths = F.sum(F.when(rank_column == 2, 10).when(rank_column == 1, 7).otherwise(4)) * 100
    n = F.count(F.lit(1))
    return F.when(tenths >= 850 * n, "high").when(tenths >= 600 * n, "medium").otherwise("low")


def summarize(clustered: DataFrame, keys: Sequence[str] = ("cluster_id", "cluster_no", "event_day", "day_sequence")) -> DataFrame:
    """One row per event: bounds, number of files, confidence."""
    epoch, position = F.col(f"{TIME}.epoch"), F.struct(F.lower("file_name"), "seq")
    first = F.struct(epoch.alias("e"), position.alias("p"))
    # of equal latest instants, the first row's text
    latest = F.min_by("effective_timestamp", F.struct((-epoch).alias("e"), position.alias("p")))
    return clustered.groupBy(*keys).agg(
        F.min_by("effective_timestamp", first).alias("timestamp_start"),
        latest.alias("timestamp_end"),
        F.count(F.lit(1)).alias("file_count"),
        confidence_of(rank(F.col("effective_timestamp_confidence"), 0)).alias("cluster_confidence"),
    )


def histogram(clustered: DataFrame, column: str, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Rows (keys, value, files): counts of a column's values by event; null is ``missing``."""
    return clustered.groupBy(*keys, F.coalesce(column, F.lit("missing")).alias("value")).agg(F.count(F.lit(1)).alias("files"))


def histogram_maps(clustered: DataFrame, column: str, name: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("value", "files")))
    return histogram(clustered, column).groupBy("cluster_id").agg(F.map_from_entries(pairs).alias(name))


FILE_FIELDS = ("file_name", "file_path", "effective_timestamp", "effective_timestamp_source", "effective_timestamp_confidence", "effective_timestamp_precision")


def file_rows(clustered: DataFrame) -> DataFrame:
    """(cluster_id, position, *FILE_FIELDS): an event's files in order, from 0, a row each,
    however many an event has."""
    first = clustered.groupBy("cluster_id").agg(F.min("file_order").alias("__first"))
    placed = clustered.join(first, "cluster_id")
    return placed.select("cluster_id", (F.col("file_order") - F.col("__first")).alias("position"), *FILE_FIELDS)


def files(clustered: DataFrame) -> DataFrame:
    """(cluster_id, files): an event's files in order, as structs, for the nested records
    that people read; an event is one row here. ``file_rows`` has no such bound."""
    order = F.struct(F.col(f"{TIME}.epoch").alias("epoch"), F.lower("file_name").alias("name"), "seq")
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*FILE_FIELDS).alias("file"))))
    return clustered.groupBy("cluster_id").agg(F.transform(ordered, lambda x: x["file"]).alias("files"))


def event_table(clustered: DataFrame) -> DataFrame:
    """The full event records, with histograms and files."""
    parts = [histogram_maps(clustered, "effective_timestamp_source", "timestamp_source_mix"), histogram_maps(clustered, "effective_timestamp_confidence", "timestamp_confidence_mix"), files(clustered)]
    out = summarize(clustered)
    for p in parts:
        out = out.join(p, "cluster_id")
    return out
