"""Scratch tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and
the session is local, as in tests on one machine, is a temporary folder made and set;
on a cluster that would be another folder on every machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="eventsort-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and returns it as read from there: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a table of fewer splits than cores is dealt out, for work that costs much a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any kind; one without a scheme is Spark's default."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_table(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One file of the concatenated ``parts``: it is written beside its place, then renamed."""
    fs, at = file_system(spark, path)
    beside = at.suffix(".new")
    out = fs.create(beside, True)
    try:
        held, size = [], 0
        for part in parts:
            held.append(part.encode())
            size += len(held[-1])
            if size > 1 << 20:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
        out.write(bytearray(b"".join(held)))
    finally:
        out.close()
    fs.delete(at, False)
    fs.rename(beside, at)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
