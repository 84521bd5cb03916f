"""File listings as a data source.

Spark's own file sources pass over names that begin with a dot or an underscore,
so listings are a source of their own: one partition for the root's entries and
one for each subtree below it.

That reads folders that executors have mounted. Folders of other file systems (a path
with a scheme) are listed by Spark's own binary file source, names and sizes only.

Options: ``path``; ``depth`` (``all`` or ``one``); ``kind`` (``file``, ``dir`` or
``all``); ``extensions`` (comma-separated, lower case; empty: any).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import MEDIA_EXTENSIONS, suffix

SCHEMA = "path string, name string, size bigint, is_dir boolean, modified double"


def extension_of(name: str) -> str:
    """The lower-cased last dot and what follows; a leading or trailing dot begins none."""
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


class _Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.deep = options.get("depth", "all") == "all"
        self.kind = options.get("kind", "file")
        self.extensions = {x for x in options.get("extensions", "").split(",") if x}
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)) if self.deep else []
        return [_Subtree(self.root, False), *(_Subtree(p, True) for p in below)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            for e in sorted(os.scandir(waiting.pop()), key=lambda e: e.name):
                folder = e.is_dir(follow_symlinks=False)
                if folder and partition.deep:
                    waiting.append(e.path)
                wanted = self.kind in ("all", "dir" if folder else "file") and (folder or e.is_file())
                if wanted and (folder or not self.extensions or extension_of(e.name) in self.extensions):
                    s = e.stat()
                    yield e.path, e.name, None if folder else s.st_size, folder, s.st_mtime


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


def _remote(spark: SparkSession, path: str, depth: str = "all", kind: str = "file", extensions: str = "") -> DataFrame:
    """The files of a folder of any file system that Spark reads."""
    if kind != "file":
        raise ValueError(f"only files are listed below {path}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(depth == "all").lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select("path", name.alias("name"), F.col("length").alias("size"), F.lit(False).alias("is_dir"), F.col("modificationTime").cast("double").alias("modified"))
    return rows.where(F.lower(suffix(F.col("name"))).isin(*extensions.split(","))) if extensions else rows


def listing(spark: SparkSession, path: str, **options: str) -> DataFrame:
    path = re.sub("^file:/+", "/", path)
    if re.match("[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return _remote(spark, path, **options)
    spark.dataSource.register(ListingSource)
    return spark.read.format("media_listing").options(path=path, **options).load()


def media(spark: SparkSession, path: str) -> DataFrame:
    """Media files anywhere under ``path``."""
    return listing(spark, path, extensions=",".join(MEDIA_EXTENSIONS))
