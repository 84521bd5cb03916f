"""Registry-shaped views of the driver's tables, the same in Spark and in SQL.

``media`` dresses ``events`` up as media files: names of every shape that the
parsers know, capture times of every kind, contents that repeat, and files without a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(number: Column, options: list[Column]) -> Column:
    out = F.when(number == 0, options[0])
    for k, o in enumerate(options[1:], 1):
        out = out.when(number == k, o)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, ts = F.col("event_id"), F.col("ts")
    n = i.cast("string")
    day, clock = F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HHmmss")
    none = F.lit(None).cast("string")
    name = _pick(i % 8, [
        F.concat(F.lit("IMG"), day, clock, F.lit(".jpg")),
        F.concat(F.lit("IMG_"), day, F.lit("_"), clock, F.lit(".JPG")),
        F.concat(F.lit("Screenshot_"), F.date_format(ts, "yyyy-MM-dd-HH-mm-ss"), F.lit(".png")),
        F.concat(F.lit("IMG-"), day, F.lit("-WA"), F.format_string("%04d", i % 10000), F.lit(".jpg")),
        F.concat(F.lit("fatura "), n, F.lit(".jpg")),
        F.concat(F.lit("DSC_"), n, F.lit(".jpg")),
        F.concat(F.lit("holiday copy ("), (i % 9).cast("string"), F.lit(").mp4")),
        F.concat(F.lit("PXL_"), day, F.lit("_"), clock, F.lit("123.jpg")),
    ])
    colons, dashes = F.date_format(ts, "yyyy:MM:dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    created = _pick(i % 7, [none, F.lit("0000:00:00 00:00:00"), colons, colons, F.concat(colons, F.lit("+01:00")), dashes, F.concat(colons, F.lit(".50"))])
    source = _pick(i % 7, [none, F.lit("CreateDate"), F.lit("DateTimeOriginal"), F.lit("FileModifyDate"), F.lit("DateTimeOriginal"), F.lit("MediaCreateDate"), F.lit("CreateDate")])
    extension = _pick(i % 5, [F.lit(x) for x in (".jpg", ".PNG", ".mp4", ".txt", ".heic")])
    rows = e.select(
        i.alias("seq"),
        "user_id",
        name.alias("file_name"),
        extension.alias("extension"),
        (i * 7 % 5000).alias("size_bytes"),
        F.when(i % 50 != 49, F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.floor("value").cast("string")), 256)).alias("hash_sha256"),
        created.alias("created_at"),
        source.alias("created_at_source"),
        F.when(i % 4 == 0, "Acme").when(i % 4 == 1, "").alias("make"),
        F.when(i % 4 == 0, "X1").when(i % 4 == 2, "Z").when(i % 4 == 1, "").alias("model"),
        F.when(i % 3 == 0, (i % 90).cast("string")).alias("latitude"),
        F.when(i % 6 == 0, (i % 180).cast("string")).alias("longitude"),
    )
    embedded = F.coalesce(F.col("created_at_source") != "FileModifyDate", F.lit(False))
    return rows.withColumns({"file_path": F.concat(F.lit("/media/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("seq").cast("string"), F.lit("/"), F.col("file_name")), "created_at_is_embedded": embedded, "has_gps": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "has_camera_metadata": F.col("seq") % 4 != 3})


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, metadata): the map that an extractor would give for each file."""
    m = media(spark, sf_dir)
    pairs = [F.struct(F.coalesce("created_at_source", F.lit("FileModifyDate")).alias("key"), F.col("created_at").alias("value"))]
    pairs += [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("Make", "make"), ("Model", "model"), ("GPSLatitude", "latitude"), ("GPSLongitude", "longitude"))]
    return m.select("seq", F.map_from_entries(F.array(*pairs)).alias("metadata"))


MEDIA_SQL = """
media AS (
  SELECT *, '/media/u' || user_id || '/' || seq || '/' || file_name AS file_path,
    coalesce(created_at_source <> 'FileModifyDate', false) AS created_at_is_embedded,
    latitude IS NOT NULL AND longitude IS NOT NULL AS has_gps, seq % 4 <> 3 AS has_camera_metadata
  FROM (
    SELECT event_id AS seq, user_id,
      CASE event_id % 8
        WHEN 0 THEN 'IMG' || strftime(ts, '%Y%m%d%H%M%S') || '.jpg'
        WHEN 1 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.JPG'
        WHEN 2 THEN 'Screenshot_' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.png'
        WHEN 3 THEN 'IMG-' || strftime(ts, '%Y%m%d') || '-WA' || printf('%04d', event_id % 10000) || '.jpg'
        WHEN 4 THEN 'fatura ' || event_id || '.jpg'
        WHEN 5 THEN 'DSC_' || event_id || '.jpg'
        WHEN 6 THEN 'holiday copy (' || (event_id % 9) || ').mp4'
        ELSE 'PXL_' || strftime(ts, '%Y%m%d_%H%M%S') || '123.jpg' END AS file_name,
      CASE event_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.txt' ELSE '.heic' END AS extension,
      event_id * 7 % 5000 AS size_bytes,
      CASE WHEN event_id % 50 <> 49 THEN sha256(user_id || ':' || CAST(floor(value) AS BIGINT)) END AS hash_sha256,
      CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '0000:00:00 00:00:00'
        WHEN 2 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y:%m:%d %H:%M:%S')
        WHEN 4 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') || '+01:00' WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') || '.50' END AS created_at,
      CASE event_id % 7 WHEN 1 THEN 'CreateDate' WHEN 2 THEN 'DateTimeOriginal' WHEN 3 THEN 'FileModifyDate'
        WHEN 4 THEN 'DateTimeOriginal' WHEN 5 THEN 'MediaCreateDate' WHEN 6 THEN 'CreateDate' END AS created_at_source,
      CASE event_id % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN '' END AS make,
      CASE event_id % 4 WHEN 0 THEN 'X1' WHEN 2 THEN 'Z' WHEN 1 THEN '' END AS model,
      CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS VARCHAR) END AS latitude,
      CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 180 AS VARCHAR) END AS longitude
    FROM events
  )
)"""

#: local: the time without zone; off: seconds of its offset.
TIMES_SQL = (
    MEDIA_SQL
    + r""",
parsed AS (
  SELECT *,
    CASE WHEN regexp_full_match(created_at, '[0-9]{4}(:[0-9]{1,2}:|-[0-9]{1,2}-)[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(Z|[+-][0-9]{2}:?[0-9]{2})?') AND created_at NOT LIKE '0000%'
      THEN try_strptime(replace(substr(created_at, 1, 10), ':', '-') || substr(created_at, 11, 9), '%Y-%m-%d %H:%M:%S') END AS exif_local,
    CASE WHEN length(created_at) > 19 AND substr(created_at, 20, 1) IN ('+', '-')
      THEN (CASE WHEN substr(created_at, 20, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(created_at, 21, 2) AS INTEGER) * 3600 + CAST(right(created_at, 2) AS INTEGER) * 60) ELSE 0 END AS exif_off,
    ' ' || regexp_replace(file_name, '^(.+)\.[^.]+$', '\1') || ' ' AS stem
  FROM media
), named AS (
  SELECT *,
    coalesce(
      try_strptime(nullif(regexp_extract(stem, '[^0-9]([0-9]{14})[^0-9]', 1), ''), '%Y%m%d%H%M%S'),
      try_strptime(nullif(regexp_extract(stem, '[^0-9]([0-9]{8}_[0-9]{6})[^0-9]', 1), ''), '%Y%m%d_%H%M%S'),
      try_strptime(nullif(replace(regexp_extract(stem, '[^0-9]([0-9]{4}-[0-9]{2}-[0-9]{2}[-_][0-9]{2}-[0-9]{2}-[0-9]{2})[^0-9]', 1), '_', '-'), ''), '%Y-%m-%d-%H-%M-%S')
    ) AS name_second,
    coalesce(
      try_strptime(nullif(regexp_extract(stem, '[^0-9]([0-9]{8})[^0-9]', 1), ''), '%Y%m%d'),
      try_strptime(nullif(regexp_extract(stem, '[^0-9]([0-9]{4}-[0-9]{2}-[0-9]{2})[^0-9]', 1), ''), '%Y-%m-%d')
    ) + INTERVAL 12 HOUR AS name_noon
  FROM parsed
), enriched AS (
  SELECT *, epoch(local)::BIGINT - off AS instant, coalesce(strftime(local, '%Y-%m-%d'), 'missing') AS event_day,
    CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rnk,
    strftime(local, '%Y-%m-%dT%H:%M:%S') || (CASE WHEN off < 0 THEN '-' ELSE '+' END) || printf('%02d:%02d', abs(off) // 3600, abs(off) % 3600 // 60) AS iso
  FROM (
    SELECT *,
      CASE w WHEN 1 THEN exif_local WHEN 2 THEN name_second WHEN 3 THEN name_noon WHEN 4 THEN exif_local END AS local,
      CASE WHEN w IN (1, 4) THEN exif_off ELSE 0 END AS off,
      CASE w WHEN 1 THEN created_at_source WHEN 2 THEN 'FilenameDateTime' WHEN 3 THEN 'FilenameDate' WHEN 4 THEN created_at_source END AS time_source,
      CASE w WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence,
      CASE w WHEN 1 THEN 'second' WHEN 2 THEN 'second' WHEN 3 THEN 'date' WHEN 4 THEN 'second' END AS prec
    FROM (SELECT *, CASE WHEN created_at_is_embedded AND exif_local IS NOT NULL THEN 1 WHEN name_second IS NOT NULL THEN 2 WHEN name_noon IS NOT NULL THEN 3 WHEN NOT created_at_is_embedded AND exif_local IS NOT NULL THEN 4 ELSE 5 END AS w FROM named)
  )
)"""
)

CLUSTERED_SQL = (
    TIMES_SQL
    + """,
flagged AS (
  SELECT *, CASE WHEN instant IS NULL OR lag(instant) OVER o IS NULL THEN 1
      WHEN prec = 'date' OR lag(prec) OVER o = 'date' THEN 0
      WHEN instant - lag(instant) OVER o > 3600 * (CASE least(rnk, lag(rnk) OVER o) WHEN 2 THEN 4 WHEN 1 THEN 8 ELSE 12 END) THEN 1 ELSE 0 END AS fresh
  FROM enriched WINDOW o AS (PARTITION BY event_day ORDER BY instant NULLS LAST, lower(file_name), seq)
), clustered AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY event_day ORDER BY instant NULLS LAST, lower(file_name), seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_sequence,
    CAST(sum(fresh) OVER (ORDER BY event_day, instant NULLS LAST, lower(file_name), seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no
  FROM flagged
), files AS (SELECT *, 'event-' || printf('%04d', cluster_no) AS cluster_id FROM clustered),
clusters AS (
  SELECT cluster_id, cluster_no, event_day, day_sequence, count(*) AS file_count,
    first(iso ORDER BY instant, lower(file_name), seq) AS timestamp_start,
    first(iso ORDER BY instant DESC, lower(file_name), seq) AS timestamp_end,
    CASE WHEN 100 * sum(CASE rnk WHEN 2 THEN 10 WHEN 1 THEN 7 ELSE 4 END) >= 850 * count(*) THEN 'high'
      WHEN 100 * sum(CASE rnk WHEN 2 THEN 10 WHEN 1 THEN 7 ELSE 4 END) >= 600 * count(*) THEN 'medium' ELSE 'low' END AS cluster_confidence
  FROM files GROUP BY ALL
)"""
)

_PENALTY_SQL = """(CASE WHEN lower(file_name) LIKE '%\\_\\_dup%' ESCAPE '\\' THEN 100 ELSE 0 END
  + CASE WHEN lower(file_name) LIKE '% copy%' OR lower(file_name) LIKE '%\\_copy%' ESCAPE '\\' THEN 50 ELSE 0 END
  + CASE WHEN regexp_matches(lower(regexp_replace(file_name, '^(.+)\\.[^.]+$', '\\1')), ' [0-9]+$') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(lower(regexp_replace(file_name, '^(.+)\\.[^.]+$', '\\1')), '\\([0-9]+\\)$') THEN 20 ELSE 0 END)"""

COPY_RANK_SQL = f"row_number() OVER (PARTITION BY hash_sha256 ORDER BY {_PENALTY_SQL}, length(file_name), lower(file_name), seq)"

PLAN_SQL = (
    CLUSTERED_SQL
    + f""",
copies AS (SELECT seq, {COPY_RANK_SQL} > 1 AS is_duplicate_secondary FROM media),
placed AS (
  SELECT *, '_' AS u, CASE action WHEN 'general_document' THEN 'general' WHEN 'general_duplicate' THEN 'general' WHEN 'general_unsorted' THEN 'general' ELSE action END AS bucket,
    CASE action WHEN 'general_document' THEN '/organized/_GENERAL/_DOCUMENTS/' || cluster_id
      WHEN 'general_duplicate' THEN '/organized/_GENERAL/_DUPLICATES/' || cluster_id
      WHEN 'general_unsorted' THEN '/organized/_GENERAL/_UNSORTED/' || cluster_id
      WHEN 'auto' THEN '/organized/' || substr(event_day, 1, 4) || '/' || substr(event_day, 6) || (CASE WHEN day_sequence = 1 THEN '' ELSE '_' || printf('%02d', day_sequence) END)
      ELSE '/organized/_REVIEW/' || event_day || '_' || cluster_id END AS folder
  FROM (
    SELECT f.*, c.file_count, c.cluster_confidence, c.timestamp_start, c.timestamp_end, d.day_cluster_count, x.is_duplicate_secondary, is_doc,
      CASE WHEN is_doc THEN 'general_document' WHEN x.is_duplicate_secondary THEN 'general_duplicate' WHEN f.event_day = 'missing' THEN 'general_unsorted'
        WHEN c.cluster_confidence = 'high' OR (c.cluster_confidence = 'medium' AND c.file_count >= 3 AND d.day_cluster_count = 1) THEN 'auto' ELSE 'review' END AS action
    FROM (SELECT *, lower(file_name) LIKE '%fatura%' AS is_doc FROM files) f
    JOIN clusters c USING (cluster_id) JOIN copies x USING (seq)
    JOIN (SELECT event_day, count(*) AS day_cluster_count FROM clusters GROUP BY 1) d ON d.event_day = f.event_day
  )
), named_plan AS (
  SELECT *, row_number() OVER (PARTITION BY lower(folder), lower(file_name) ORDER BY cluster_no, instant, lower(file_name), seq) AS turn FROM placed
)"""
)
