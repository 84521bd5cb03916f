"""Duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import duplicate_penalty
from .positions import turns


def group_rows(registry: DataFrame) -> DataFrame:
    """(hash_sha256, files, position, file_path) of hashes that several files have, a row
    for each file, in order of seq from 0."""
    counts = registry.groupBy(F.col("hash_sha256").alias("__hash")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    rows = turns(registry, ["hash_sha256"], ["seq"], "__turn").join(counts, F.col("hash_sha256").eqNullSafe(F.col("__hash")))
    return rows.select("hash_sha256", "files", (F.col("__turn") - 1).alias("position"), "file_path")


def groups(registry: DataFrame) -> DataFrame:
    """(hash_sha256, files, paths) of hashes that several files have, paths in order of seq:
    a hash is one row here, for reports. ``group_rows`` has no such bound."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "file_path"))), lambda x: x["file_path"])
    return registry.groupBy("hash_sha256").agg(F.count(F.lit(1)).alias("files"), ordered.alias("paths")).where("files > 1")


def flag(registry: DataFrame) -> DataFrame:
    """Adds primary_path and is_duplicate_secondary. The primary file of a hash has the
    least penalty, then the shortest name, then the first name, then the least seq.

    The primaries are aggregated before any row moves, so that a hash that a large
    part of all files has is one row of the table that is joined. Files without a hash
    stay and are one group, as in ``groups``."""
    key = F.struct(duplicate_penalty(F.col("file_name")).alias("p"), F.length("file_name").alias("n"), F.lower("file_name").alias("l"), F.col("seq").alias("s"))
    primary = registry.groupBy(F.col("hash_sha256").alias("__hash")).agg(F.min_by("file_path", key).alias("primary_path"))
    joined = registry.join(primary, F.col("hash_sha256").eqNullSafe(F.col("__hash")))
    others = [f"`{c}`" for c in registry.columns if c != "hash_sha256"]
    secondary = F.coalesce(F.col("file_path") != F.col("primary_path"), F.lit(False))
    return joined.select("hash_sha256", *others, "primary_path").withColumn("is_duplicate_secondary", secondary)


def ranked(registry: DataFrame) -> DataFrame:
    """Adds copy_rank: 1 for the primary file of a hash, then by the same order."""
    by = {"__p": duplicate_penalty(F.col("file_name")), "__n": F.length("file_name"), "__l": F.lower("file_name")}
    rows = turns(registry.withColumns(by), ["hash_sha256"], [*by, "seq"], "copy_rank")
    return rows.withColumn("copy_rank", F.col("copy_rank").cast("int")).drop(*by)
