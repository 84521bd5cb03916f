"""Queries over sources, sinks and actions: what they write is read again, and files
are made from the driver's tables. All of it is under the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testviews as v
from .catalogue import query
from .operators import normalize
from .plans import actions, steps
from .scratch import new_path, read_text, write_table
from .sources import content, files
from .sources.listing import listing, media

_ROW = "seq bigint, file_name string, created_at string, has_gps boolean"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.media(spark, sf_dir).select("seq", "file_name", "created_at", "has_gps")


@query("SELECT seq, file_name, created_at, has_gps FROM media", v.MEDIA_SQL)
def json_lines_again(spark, sf_dir):
    """JSON lines as written, with explicit nulls, and read with a schema."""
    path = new_path(spark, "lines")
    files.write_lines(_rows(spark, sf_dir), path)
    nulls = spark.read.text(path).where("value like '%\"created_at\":null%'").isEmpty()
    return files.read_lines(spark, path, _ROW).where(F.lit(not nulls))


@query("SELECT seq, file_name, created_at, has_gps FROM media", v.MEDIA_SQL)
def json_array_again(spark, sf_dir):
    path = new_path(spark, "array") + ".json"
    files.write_array(_rows(spark, sf_dir), path, "seq")
    return files.read_array(spark, path, _ROW)


@query("SELECT CAST(seq AS VARCHAR) AS seq, file_name, created_at, CASE WHEN has_gps THEN 'True' ELSE 'False' END AS has_gps FROM media", v.MEDIA_SQL)
def csv_again(spark, sf_dir):
    path = new_path(spark, "csv")
    files.write_csv(_rows(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


@query("SELECT extension, file_name, 2 * count(*) AS lines FROM media GROUP BY 1, 2", v.MEDIA_SQL)
def log_appended(spark, sf_dir):
    """Lines of a log that two runs append to, without their times."""
    path = new_path(spark, "log")
    for _ in range(2):
        files.append_log(v.media(spark, sf_dir), path, "extension", "file_name")
    parts = F.split("value", r" \| ", 3)
    timed = spark.read.text(path).where(F.col("value").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}"))
    return timed.groupBy(parts[1].alias("extension"), parts[2].alias("file_name")).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT extension, count(*) AS files FROM media GROUP BY 1", v.MEDIA_SQL)
def summary_object(spark, sf_dir):
    """A summary's JSON object."""
    counts = v.media(spark, sf_dir).groupBy("extension").agg(F.count(F.lit(1)).alias("files"))
    path = new_path(spark, "summary") + ".json"
    files.write_summary(spark, {r["extension"]: r["files"] for r in counts.collect()}, path)
    read = spark.range(1).select(F.from_json(F.lit(read_text(spark, path)), "map<string,bigint>").alias("m"))
    return read.select(F.explode("m").alias("extension", "files"))


@query("SELECT seq, file_name, extension FROM media ORDER BY seq LIMIT 10", v.MEDIA_SQL)
def first_rows(spark, sf_dir):
    """A preview."""
    return steps.preview(v.media(spark, sf_dir), "seq", 10, ("seq", "file_name", "extension"))


@query(
    "SELECT seq, CASE WHEN source = 'CreateDate' THEN 'CreateDate,GPSLatitude,GPSLongitude,Make,Model,SourceFile' ELSE 'GPSLatitude,GPSLongitude,Make,MediaCreateDate,Model,SourceFile' END AS keys "
    "FROM (SELECT seq, coalesce(created_at_source, 'FileModifyDate') AS source FROM media) WHERE source IN ('CreateDate', 'MediaCreateDate')",
    v.MEDIA_SQL,
)
def extracted_keys(spark, sf_dir):
    """Sorted keys of metadata that an extractor left as JSON lines."""
    path = new_path(spark, "metadata")
    rows = v.metadata(spark, sf_dir).select(F.map_concat("metadata", F.create_map(F.lit("SourceFile"), F.col("seq").cast("string"))).alias("m"))
    rows.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    read = normalize.normalize(content.read_metadata(spark, path).select(F.col("path").cast("long").alias("seq"), "metadata"))
    source = F.array_intersect("raw_exif_keys", F.array(F.lit("CreateDate"), F.lit("MediaCreateDate")))
    return read.where(F.size(source) > 0).select("seq", F.array_join("raw_exif_keys", ",").alias("keys"))


def _write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, data in zip(frame["path"], frame["data"], strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(data)
        yield frame[["path"]]


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Files of nations, by region, under a local view of the shared folder: (path, key, region), and the folder."""
    root = "/" + new_path(spark, "files").split(":")[-1].lstrip("/")
    name = F.concat(F.col("n_name"), F.element_at(F.array(*map(F.lit, (".jpg", ".MP4", ".txt"))), (F.col("n_nationkey") % 3 + 1).cast("int")))
    rows = v.table(spark, sf_dir, "nation").select(F.concat_ws("/", F.lit(root), F.col("n_regionkey").cast("string"), name).alias("path"), F.concat(F.col("n_name"), F.lit(" "), F.col("n_nationkey").cast("string")).alias("data"), "n_nationkey", "n_regionkey")
    write_table(rows.mapInPandas(_write, "path string"), new_path(spark, "written"))
    return rows, root


_NATIONS_SQL = """nations AS (
  SELECT n_nationkey AS k, n_regionkey AS r, n_name || CASE n_nationkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' ELSE '.txt' END AS name, n_name || ' ' || n_nationkey AS data FROM nation
)"""


@query("SELECT name, CAST(length(data) AS BIGINT) AS size, sha256(data) AS hash_sha256 FROM nations WHERE k % 3 < 2", _NATIONS_SQL)
def listed_media(spark, sf_dir):
    """Media files of a folder tree, with their hashes."""
    _, root = _nations(spark, sf_dir)
    found = media(spark, root)
    return found.join(content.hash_files(found), "path").where("error is null").select("name", "size", "hash_sha256")


@query("SELECT name, CAST(length(data) AS BIGINT) AS size FROM nations", _NATIONS_SQL)
def listed_files(spark, sf_dir):
    """All files, without a filter, from folders that a listing of one level found."""
    _, root = _nations(spark, sf_dir)
    folders = listing(spark, root, depth="one", kind="dir").select(F.col("name").alias("folder"))
    below = listing(spark, root).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return below.join(folders, "folder").select("name", "size")


_PLACED_SQL = _NATIONS_SQL + """, placed AS (
  SELECT k, data, row_number() OVER (PARTITION BY r ORDER BY k) AS turn, r FROM nations
)"""


def _into_one_name(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Every file of a region is to become the region's a.jpg; one source is gone, and a region's a.jpg is there."""
    rows, root = _nations(spark, sf_dir)
    there = spark.createDataFrame([(f"{root}/to/0/a.jpg", "something else")], "path string, data string")
    write_table(there.mapInPandas(_write, "path string"), new_path(spark, "written"))
    source = F.when(F.col("n_nationkey") == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    work = rows.select(source.alias("source"), F.concat(F.lit(f"{root}/to/"), F.col("n_regionkey").cast("string"), F.lit("/a.jpg")).alias("target"), F.col("n_nationkey").cast("long").alias("seq"), "n_regionkey")
    return work, root


_ACTED_SQL = """SELECT CAST(k AS BIGINT) AS seq, CASE WHEN k = 1 THEN 'source_missing' ELSE '{done}' END AS outcome,
  CASE WHEN k = 1 OR turn = 1 THEN 'a.jpg' ELSE 'a__dup' || printf('%02d', turn) || '.jpg' END AS final, CASE WHEN k <> 1 THEN sha256(data) END AS found
FROM (SELECT k, r, data, row_number() OVER (PARTITION BY r ORDER BY k) + CAST(r = 0 AS INTEGER) AS turn FROM placed WHERE k <> 1 UNION ALL SELECT k, r, data, 0 FROM placed WHERE k = 1)"""


def _acted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """What two runs over one decided table leave behind."""
    work, _ = _into_one_name(spark, sf_dir)
    decided = actions.decide(work, kind)
    write_table(actions.act(decided, kind), new_path(spark, "acted"))
    done = write_table(actions.act(decided, kind), new_path(spark, "acted"))
    hashes = content.hash_files(done.where("outcome <> 'source_missing'").select(F.col("final").alias("path"))).select(F.col("path").alias("final"), F.col("hash_sha256").alias("found"))
    rows = done.join(hashes, "final", "left")
    return rows.select("seq", "outcome", F.element_at(F.split("final", "/"), -1).alias("final"), F.when(F.col("outcome") != "source_missing", F.col("found")).alias("found"))


@query(_ACTED_SQL.format(done="copied"), _PLACED_SQL)
def copied_files(spark, sf_dir):
    return _acted(spark, sf_dir, "copy")


@query(_ACTED_SQL.format(done="files_moved"), _PLACED_SQL)
def moved_files(spark, sf_dir):
    return _acted(spark, sf_dir, "move")


@query("SELECT CAST(k AS BIGINT) AS seq, CASE WHEN k = 1 THEN 'source_missing' WHEN r = 0 THEN 'skipped_conflict' ELSE 'dry_run_planned' END AS outcome FROM nations", _NATIONS_SQL)
def planned_copies(spark, sf_dir):
    """A dry run that gives no other names, against the disk; it makes no folder."""
    work, root = _into_one_name(spark, sf_dir)
    done = write_table(actions.perform(work, "copy", rename=False), new_path(spark, "planned"))
    made = listing(spark, f"{root}/to", depth="one", kind="dir").count()
    return done.where(F.lit(made == 1)).select("seq", "outcome")


@query("SELECT region AS folder FROM (SELECT CAST(n_regionkey AS VARCHAR) AS region, count(*) FILTER (n_nationkey % 3 < 2 AND n_regionkey > 1) AS held FROM nation GROUP BY 1) WHERE held = 0")
def folders_without_files(spark, sf_dir):
    rows, root = _nations(spark, sf_dir)
    held = rows.where("n_nationkey % 3 < 2 and n_regionkey > 1").select("path")
    folders = listing(spark, root, depth="one", kind="dir").select("path")
    return actions.empty_folders(folders, held).select(F.element_at(F.split("path", "/"), -1).alias("folder"))
