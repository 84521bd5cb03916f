"""Readers and writers of registries, events, plans, logs and summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..scratch import file_system, write_text


def need(spark: SparkSession, path: str, what: str) -> str:
    """``path``, of any file system, if it is there."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are passed over, a malformed line ends the run."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.REGISTRY)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.EVENTS)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.PLAN)


def write_lines(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """JSON lines with explicit nulls; ``single``: one file."""
    out = df.orderBy(order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(plan: DataFrame, path: str, order: str | None = None) -> None:
    """A header, and booleans with a capital."""
    columns = [F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in plan.dtypes]
    out = plan.orderBy(order) if order else plan
    out.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_array(df: DataFrame, path: str, order: str) -> None:
    """A pretty JSON array in one file, row by row: rows stream through the driver."""
    rows = df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def parts() -> Iterator[str]:
        yield "["
        for k, r in enumerate(rows.toLocalIterator()):
            text = json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            yield ("," if k else "") + "\n  " + text
        yield "\n]"

    write_text(df.sparkSession, path, parts())


def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat()


def write_summary(spark: SparkSession, summary: dict, path: str) -> dict:
    write_text(spark, path, [json.dumps(summary, ensure_ascii=False, indent=2)])
    return summary


def log_lines(rows: DataFrame, *parts: str) -> DataFrame:
    """(value): time | part | part ... of every row."""
    time = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return rows.select(F.concat_ws(" | ", time, *parts).alias("value"))


def append_log(rows: DataFrame, path: str, *parts: str) -> None:
    log_lines(rows, *parts).write.mode("append").text(path)
