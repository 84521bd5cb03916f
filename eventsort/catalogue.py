"""Queries over the operators, and the same in SQL, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testviews as v
from .functions import exif_time, filename_time, text
from .operators import cluster, dedup, enrich, naming, normalize, plan, review, select, summary
from .scratch import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ROOT = "/organized"


def query(sql: str | None = None, views: str = ""):
    """Registers a query and its SQL; ``views``: common table expressions in front."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {views.strip()} {sql}" if views else sql
        return f

    return register


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(spread(v.media(spark, sf_dir)))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_enriched(spark, sf_dir))


def _plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = _clustered(spark, sf_dir)
    return plan.plan_rows(dedup.flag(clustered), cluster.summarize(clustered), ROOT)


# --- registry ---


@query("SELECT seq, file_name, extension FROM media WHERE lower(extension) IN ('.jpg', '.jpeg', '.png', '.webp', '.heic', '.heif', '.tif', '.tiff', '.mp4', '.mov', '.avi', '.mkv', '.webm')", v.MEDIA_SQL)
def scan_filter_ext(spark, sf_dir):
    return v.media(spark, sf_dir).where(text.is_media(F.col("extension"))).select("seq", "file_name", "extension")


@query(
    """SELECT seq, created_at, CASE WHEN created_at IS NOT NULL THEN created_at_source END AS created_at_source,
  created_at IS NOT NULL AND created_at_is_embedded AS created_at_is_embedded,
  CASE WHEN make <> '' AND model <> '' THEN trim(make || ' ' || model) WHEN make <> '' THEN make ELSE model END AS camera,
  CASE WHEN has_gps THEN CAST(latitude AS DOUBLE) END AS latitude, CASE WHEN has_gps THEN CAST(longitude AS DOUBLE) END AS longitude,
  seq % 4 <> 3 AS has_camera_metadata, has_gps, CAST(5 AS BIGINT) AS n_keys FROM media""",
    v.MEDIA_SQL,
)
def normalize_metadata(spark, sf_dir):
    rows = normalize.normalize(v.metadata(spark, sf_dir))
    return rows.select("seq", "exif.created_at", "exif.created_at_source", "exif.created_at_is_embedded", "exif.camera", "exif.gps.latitude", "exif.gps.longitude", "metadata_quality.has_camera_metadata", "metadata_quality.has_gps", F.size("raw_exif_keys").cast("long").alias("n_keys"))


@query("SELECT extension, count(*) AS files FROM media GROUP BY 1", v.MEDIA_SQL)
def registry_by_extension(spark, sf_dir):
    return summary.by_extension(v.media(spark, sf_dir))


@query("SELECT coalesce(created_at_source, 'missing') AS timestamp_source, count(*) AS files FROM media GROUP BY 1", v.MEDIA_SQL)
def registry_by_source(spark, sf_dir):
    return summary.by_source(v.media(spark, sf_dir))


@query("SELECT coalesce(replace(substr(created_at, 1, 10), ':', '-'), 'missing') AS date, count(*) AS files FROM media GROUP BY 1 ORDER BY 1", v.MEDIA_SQL)
def registry_by_date(spark, sf_dir):
    return summary.by_date(v.media(spark, sf_dir)).orderBy("date")


@query(
    """SELECT count(*) AS total_files, count(*) FILTER (created_at_is_embedded) AS embedded_capture_time_count, count(*) FILTER (NOT created_at_is_embedded) AS filesystem_only_count,
  count(*) FILTER (has_gps) AS gps_count, count(*) FILTER (has_camera_metadata) AS camera_metadata_count FROM media""",
    v.MEDIA_SQL,
)
def registry_quality_counts(spark, sf_dir):
    return summary.quality(v.media(spark, sf_dir))


# --- times ---


@query(
    "SELECT seq, strftime(exif_local, '%Y-%m-%dT%H:%M:%S') AS local_text, CASE WHEN exif_local IS NOT NULL THEN exif_off END AS offset_s, epoch(exif_local)::BIGINT - exif_off AS instant FROM parsed",
    v.TIMES_SQL,
)
def parse_exif_time(spark, sf_dir):
    t = exif_time.parse(F.col("created_at"))
    rows = v.media(spark, sf_dir).select("seq", t.alias("t"))
    return rows.select("seq", F.date_format("t.local", "yyyy-MM-dd'T'HH:mm:ss").alias("local_text"), F.col("t.offset_s").alias("offset_s"), F.col("t.epoch").alias("instant"))


@query(
    "SELECT seq, strftime(coalesce(name_second, name_noon), '%Y-%m-%dT%H:%M:%S') AS local_text, CASE WHEN name_second IS NOT NULL THEN 'second' WHEN name_noon IS NOT NULL THEN 'date' END AS prec FROM named",
    v.TIMES_SQL,
)
def parse_filename_time(spark, sf_dir):
    rows = v.media(spark, sf_dir).select("seq", filename_time.parse(F.col("file_name")).alias("t"))
    return rows.select("seq", F.date_format("t.time.local", "yyyy-MM-dd'T'HH:mm:ss").alias("local_text"), F.col("t.precision").alias("prec"))


@query("SELECT seq, iso AS effective_timestamp, time_source, confidence, prec, event_day FROM enriched", v.TIMES_SQL)
def effective_timestamp(spark, sf_dir):
    rows = _enriched(spark, sf_dir)
    return rows.select("seq", "effective_timestamp", F.col("effective_timestamp_source").alias("time_source"), F.col("effective_timestamp_confidence").alias("confidence"), F.col("effective_timestamp_precision").alias("prec"), enrich.event_day(F.col(enrich.TIME)).alias("event_day"))


# --- events ---


@query("SELECT cluster_id, event_day, day_sequence, file_count, timestamp_start, timestamp_end, cluster_confidence FROM clusters", v.CLUSTERED_SQL)
def event_clusters_global(spark, sf_dir):
    return cluster.summarize(_clustered(spark, sf_dir)).select("cluster_id", "event_day", "day_sequence", "file_count", "timestamp_start", "timestamp_end", "cluster_confidence")


@query(
    """flagged AS (
  SELECT user_id, event_id, ts, strftime(ts, '%Y-%m-%d') AS event_day, event_id % 3 AS rnk, epoch(date_trunc('second', ts))::BIGINT AS instant FROM events
), gaps AS (
  SELECT *, CASE WHEN lag(instant) OVER o IS NULL THEN 1
    WHEN instant - lag(instant) OVER o > 3600 * (CASE least(rnk, lag(rnk) OVER o) WHEN 2 THEN 4 WHEN 1 THEN 8 ELSE 12 END) THEN 1 ELSE 0 END AS fresh
  FROM flagged WINDOW o AS (PARTITION BY user_id, event_day ORDER BY instant, event_id)
), numbered AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id, event_day ORDER BY instant, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_sequence FROM gaps
) SELECT user_id, event_day, day_sequence, count(*) AS file_count, min(instant) AS first_instant, max(instant) AS last_instant,
  CASE WHEN 100 * sum(CASE rnk WHEN 2 THEN 10 WHEN 1 THEN 7 ELSE 4 END) >= 850 * count(*) THEN 'high'
    WHEN 100 * sum(CASE rnk WHEN 2 THEN 10 WHEN 1 THEN 7 ELSE 4 END) >= 600 * count(*) THEN 'medium' ELSE 'low' END AS cluster_confidence
FROM numbered GROUP BY user_id, event_day, day_sequence""".replace("flagged AS", "WITH flagged AS", 1)
)
def event_clusters_per_user(spark, sf_dir):
    """Gap clustering of each user's events."""
    e = v.table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("event_day"), (F.col("event_id") % 3).alias("rnk"), exif_time.epoch(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("instant"))
    point = F.struct(F.col("instant").alias("epoch"), F.col("rnk").alias("rank"), F.lit("second").alias("precision"))
    numbered = cluster.number_events(rows, point, (F.col("instant"), F.col("event_id")), ["user_id"])
    return numbered.groupBy("user_id", "event_day", "day_sequence").agg(F.count(F.lit(1)).alias("file_count"), F.min("instant").alias("first_instant"), F.max("instant").alias("last_instant"), cluster.confidence_of(F.col("rnk")).alias("cluster_confidence"))


@query("SELECT cluster_id, coalesce(time_source, 'missing') AS value, count(*) AS files FROM files GROUP BY 1, 2", v.CLUSTERED_SQL)
def cluster_source_histogram(spark, sf_dir):
    return cluster.histogram(_clustered(spark, sf_dir), "effective_timestamp_source")


@query("SELECT cluster_id, confidence AS value, count(*) AS files FROM files GROUP BY 1, 2", v.CLUSTERED_SQL)
def cluster_confidence_histogram(spark, sf_dir):
    return cluster.histogram(_clustered(spark, sf_dir), "effective_timestamp_confidence")


@query(
    "SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY instant, lower(file_name), seq) - 1 AS INTEGER) AS position, file_name, file_path, iso AS effective_timestamp, prec FROM files",
    v.CLUSTERED_SQL,
)
def cluster_files(spark, sf_dir):
    events = cluster.files(_clustered(spark, sf_dir))
    return plan.from_records(events).select("cluster_id", "position", "file_name", "file_path", "effective_timestamp", F.col("effective_timestamp_precision").alias("prec"))


@query("SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY instant, lower(file_name), seq) - 1 AS position, file_path, time_source FROM files", v.CLUSTERED_SQL)
def cluster_file_rows(spark, sf_dir):
    return cluster.file_rows(_clustered(spark, sf_dir)).select("cluster_id", "position", "file_path", F.col("effective_timestamp_source").alias("time_source"))


@query("SELECT cluster_id, event_day, file_count, cluster_confidence FROM clusters ORDER BY cluster_no LIMIT 10", v.CLUSTERED_SQL)
def top10_clusters(spark, sf_dir):
    return cluster.summarize(_clustered(spark, sf_dir)).orderBy("cluster_no").limit(10).select("cluster_id", "event_day", "file_count", "cluster_confidence")


@query("SELECT event_day, count(*) AS day_cluster_count, max(day_sequence) AS last_sequence FROM clusters GROUP BY 1", v.CLUSTERED_SQL)
def day_cluster_counts(spark, sf_dir):
    events = plan.day_counts(cluster.summarize(_clustered(spark, sf_dir)))
    return events.groupBy("event_day").agg(F.max("day_cluster_count").alias("day_cluster_count"), F.max("day_sequence").alias("last_sequence"))


# --- duplicates and documents ---


@query("SELECT sha256(text) AS hash_sha256, count(*) AS files, min(doc_id) AS first_seq FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash_groups(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash_sha256"), F.col("doc_id").alias("seq"))
    return docs.groupBy("hash_sha256").agg(F.count(F.lit(1)).alias("files"), F.min("seq").alias("first_seq")).where("files > 1")


@query("SELECT hash_sha256, len(paths) AS files, paths[1] AS first_path, paths[-1] AS last_path FROM (SELECT hash_sha256, list(file_path ORDER BY seq) AS paths FROM media GROUP BY 1 HAVING count(*) > 1)", v.MEDIA_SQL)
def duplicate_path_groups(spark, sf_dir):
    g = dedup.groups(v.media(spark, sf_dir))
    return g.select("hash_sha256", "files", F.element_at("paths", 1).alias("first_path"), F.element_at("paths", -1).alias("last_path"))


@query("SELECT hash_sha256, files, row_number() OVER (PARTITION BY hash_sha256 ORDER BY seq) - 1 AS position, file_path FROM (SELECT *, count(*) OVER (PARTITION BY hash_sha256) AS files FROM media) WHERE files > 1", v.MEDIA_SQL)
def duplicate_path_rows(spark, sf_dir):
    return dedup.group_rows(v.media(spark, sf_dir))


@query(f"SELECT seq, r AS copy_rank, first(file_path) OVER (PARTITION BY hash_sha256 ORDER BY r) AS primary_path FROM (SELECT *, CAST({v.COPY_RANK_SQL} AS INTEGER) AS r FROM media)", v.MEDIA_SQL)
def duplicate_ranking(spark, sf_dir):
    rows = dedup.flag(dedup.ranked(v.media(spark, sf_dir)))
    return rows.select("seq", "copy_rank", "primary_path")


@query(f"SELECT seq, hash_sha256 FROM (SELECT *, {v.COPY_RANK_SQL} AS r FROM media) WHERE r > 1", v.MEDIA_SQL)
def duplicate_secondary(spark, sf_dir):
    return dedup.flag(v.media(spark, sf_dir)).where("is_duplicate_secondary").select("seq", "hash_sha256")


_KEYWORDS_SQL = "[" + ", ".join(f"'{k}'" for k in text.DOCUMENT_KEYWORDS) + ", 'holiday', 'birthday']"


@query(
    f"""SELECT seq, len([k FOR k IN list_slice({_KEYWORDS_SQL}, 1, -3) IF contains(lower(file_name), k)]) > 0 AS is_document
FROM (SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN w ELSE upper(w) END || ' ' || event_id || '.jpg' AS file_name FROM (SELECT event_id, 'x' || list_extract({_KEYWORDS_SQL}, CAST(event_id % 23 AS INTEGER) + 1) AS w FROM events))"""
)
def document_flag(spark, sf_dir):
    """Names with each of the keywords, in either case, and with words that are none."""
    i = F.col("event_id")
    options = F.array(*map(F.lit, (*text.DOCUMENT_KEYWORDS, "holiday", "birthday")))
    word = F.concat(F.lit("x"), F.element_at(options, (i % 23 + 1).cast("int")))
    name = F.concat(F.when(i % 2 == 0, word).otherwise(F.upper(word)), F.lit(" "), i.cast("string"), F.lit(".jpg"))
    return v.table(spark, sf_dir, "events").select(i.alias("seq"), text.is_document(name).alias("is_document"))


@query(r"SELECT seq, CASE WHEN s = '' THEN 'unknown' ELSE s END AS safe FROM (SELECT seq, trim(regexp_replace(replace(file_name, ' ', '_'), '[^\p{L}\p{N}_-]', '', 'g'), '_') AS s FROM media)", v.MEDIA_SQL)
def safe_folder(spark, sf_dir):
    return v.media(spark, sf_dir).select("seq", text.folder_part(F.col("file_name")).alias("safe"))


# --- plan ---

_PLANNED = (
    "cluster_id, event_day, cluster_confidence, file_count AS cluster_file_count, day_cluster_count, bucket = 'review' AS review_recommended, bucket AS proposed_bucket, action AS proposed_action, "
    "timestamp_start, timestamp_end, file_path AS source_path, folder AS proposed_folder, file_name, iso AS effective_timestamp, is_doc AS is_document, is_duplicate_secondary, hash_sha256"
)


@query(
    "SELECT cluster_id, event_day <> 'missing' AND (cluster_confidence = 'high' OR (cluster_confidence = 'medium' AND file_count >= 3 AND n = 1)) AS auto FROM (SELECT *, count(*) OVER (PARTITION BY event_day) AS n FROM clusters)",
    v.CLUSTERED_SQL,
)
def auto_policy(spark, sf_dir):
    e = plan.day_counts(cluster.summarize(_clustered(spark, sf_dir)))
    return e.select("cluster_id", plan.auto_approved(F.col("event_day"), F.col("cluster_confidence"), F.col("file_count"), F.col("day_cluster_count")).alias("auto"))


@query(
    f"SELECT {_PLANNED}, folder || '/' || (CASE WHEN turn = 1 THEN file_name ELSE regexp_replace(file_name, '^(.+)\\.([^.]+)$', '\\1__dup' || printf('%02d', turn) || '.\\2') END) AS proposed_destination FROM named_plan",
    v.PLAN_SQL,
)
def move_plan(spark, sf_dir):
    """The plan with destinations; no file of this view is named like a numbered copy."""
    clustered = _clustered(spark, sf_dir)
    built = plan.build(dedup.flag(clustered), cluster.summarize(clustered), ROOT)
    return built.drop("seq", "effective_timestamp_source", "effective_timestamp_confidence", "effective_timestamp_precision")


@query("SELECT counter, sum(n)::BIGINT AS files FROM (SELECT 'bucket_' || bucket AS counter, count(*) AS n FROM placed GROUP BY 1 UNION ALL SELECT 'action_' || action, count(*) FROM placed GROUP BY 1) GROUP BY 1", v.PLAN_SQL)
def plan_counters(spark, sf_dir):
    return summary.plan_counts(_plan_rows(spark, sf_dir))


@query("SELECT bucket AS proposed_bucket, count(DISTINCT cluster_id) AS clusters FROM placed GROUP BY 1", v.PLAN_SQL)
def bucket_clusters(spark, sf_dir):
    return summary.clusters_per_bucket(_plan_rows(spark, sf_dir))


@query(
    r"""WITH RECURSIVE wanted AS (
  SELECT seq, folder, name, row_number() OVER (PARTITION BY folder ORDER BY seq) AS turn, regexp_replace(name, '\.[^.]+$', '') AS bare, regexp_extract(name, '\.[^.]+$') AS ending
  FROM (SELECT event_id AS seq, '/organized/' || (event_id % 97) AS folder, list_extract(['a__dup02.jpg', 'A.JPG', 'a.jpg', 'b.png', 'a__dup03.jpg'], CAST(event_id % 5 AS INTEGER) + 1) AS name FROM events)
), given AS (
  SELECT folder, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS chosen FROM wanted GROUP BY folder
  UNION ALL
  SELECT folder, turn, list_append(taken, lower(chosen)), seq, name, chosen FROM (
    SELECT w.folder, w.turn, g.taken, w.seq, w.name, list_filter(list_concat([w.name], list_transform(range(2, len(g.taken) + 3), lambda n: w.bare || '__dup' || printf('%02d', n) || w.ending)), lambda c: NOT list_contains(g.taken, lower(c)))[1] AS chosen
    FROM given g JOIN wanted w ON w.folder = g.folder AND w.turn = g.turn + 1
  )
) SELECT seq, folder AS proposed_folder, name AS file_name, folder || '/' || chosen AS proposed_destination FROM given WHERE seq IS NOT NULL"""
)
def destination_allocation(spark, sf_dir):
    """Names that clash with numbered copies of others, which need the allocation itself."""
    i = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("a__dup02.jpg", "A.JPG", "a.jpg", "b.png", "a__dup03.jpg"))), (i % 5 + 1).cast("int"))
    rows = v.table(spark, sf_dir, "events").select(i.alias("seq"), F.concat(F.lit("/organized/"), (i % 97).cast("string")).alias("proposed_folder"), name.alias("file_name"))
    return naming.name_destinations(rows, "seq")


@query("SELECT cluster_id, folder AS proposed_folder, file_name FROM placed WHERE cluster_confidence IN ('medium', 'high') AND bucket <> 'review'", v.PLAN_SQL)
def apply_selection(spark, sf_dir):
    by = select.Selection(min_confidence="medium", only_auto_approved=True)
    return select.chosen(_plan_rows(spark, sf_dir), by).select("cluster_id", "proposed_folder", "file_name")


@query("SELECT cluster_confidence, count(*) AS files, count(DISTINCT cluster_id) AS clusters FROM placed WHERE cluster_confidence IN ('medium', 'high') GROUP BY 1", v.PLAN_SQL)
def apply_summary(spark, sf_dir):
    return summary.selection(select.chosen(_plan_rows(spark, sf_dir), select.Selection(min_confidence="medium")))


@query(
    """SELECT outcome AS counter, count(*) AS n FROM (SELECT CASE WHEN seq % 10 = 0 THEN 'source_missing' WHEN seq % 10 = 1 THEN 'skipped_existing' WHEN seq % 10 = 2 THEN 'skipped_conflict' ELSE 'dry_run_planned' END AS outcome FROM media) GROUP BY 1""",
    v.MEDIA_SQL,
)
def apply_outcomes(spark, sf_dir):
    """Outcomes of a dry run against two listings."""
    m = v.media(spark, sf_dir).select("seq", F.col("file_path").alias("source_path"), F.concat(F.lit("/target/"), F.col("seq").cast("string")).alias("proposed_destination"), "size_bytes")
    kind = F.col("seq") % 10
    sources = m.where(kind != 0).select(F.col("source_path").alias("path"), F.col("size_bytes").alias("size"))
    targets = m.where(kind.isin(1, 2)).select(F.col("proposed_destination").alias("path"), (F.col("size_bytes") + F.when(kind == 2, 1).otherwise(0)).alias("size"))
    return summary.outcomes(select.dry_run(select.probe(m, sources, targets), select.Selection()))


@query(
    """, folders AS (
  SELECT cluster_no, CASE cluster_no % 5 WHEN 0 THEN event_day || '_' || cluster_id || '_A' WHEN 1 THEN event_day || '_' || cluster_id || '_G' WHEN 2 THEN event_day || '_' || cluster_id
    WHEN 3 THEN 'trip' || cluster_no || '_G' ELSE 'x_event-9' || cluster_no || '99_A' END AS folder_name FROM clusters
), decided AS (
  SELECT *, nullif(regexp_extract(folder_name, '^(.+)_([AG])$', 1), '') AS base_name, nullif(regexp_extract(folder_name, '^(.+)_([AG])$', 2), '') AS decision,
    nullif(regexp_extract(regexp_extract(folder_name, '^(.+)_([AG])$', 1), '(event-[0-9]{4,})', 1), '') AS cid FROM folders
) SELECT folder_name, base_name, decision, d.cid AS cluster_id,
  CASE WHEN decision IS NULL THEN 'ignored_no_suffix' WHEN d.cid IS NULL THEN 'ignored_no_cluster_id' ELSE 'decided' END AS status,
  CASE WHEN d.cid IS NOT NULL THEN coalesce(c.event_day, 'missing') END AS event_day,
  CASE WHEN d.cid IS NULL THEN NULL WHEN decision = 'G' THEN '/organized/_GENERAL/' || base_name
    WHEN coalesce(c.event_day, 'missing') = 'missing' THEN '/organized/_GENERAL/_UNSORTED/' || d.cid
    ELSE '/organized/' || substr(c.event_day, 1, 4) || '/' || substr(c.event_day, 6) || (CASE WHEN c.day_sequence = 1 THEN '' ELSE '_' || printf('%02d', c.day_sequence) END) END AS target_folder
FROM decided d LEFT JOIN clusters c ON c.cluster_id = d.cid""",
    v.CLUSTERED_SQL,
)
def review_decisions(spark, sf_dir):
    events = cluster.summarize(_clustered(spark, sf_dir))
    n = F.col("cluster_no")
    full = F.concat("event_day", F.lit("_"), "cluster_id")
    name = F.when(n % 5 == 0, F.concat(full, F.lit("_A"))).when(n % 5 == 1, F.concat(full, F.lit("_G"))).when(n % 5 == 2, full).when(n % 5 == 3, F.concat(F.lit("trip"), n.cast("string"), F.lit("_G"))).otherwise(F.concat(F.lit("x_event-9"), n.cast("string"), F.lit("99_A")))
    routed = review.route(events.select(name.alias("folder_name")), events, ROOT, f"{ROOT}/_GENERAL")
    return routed.select("folder_name", "base_name", "decision", "cluster_id", "status", "event_day", "target_folder")
