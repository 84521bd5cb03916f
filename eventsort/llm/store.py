"""What the operators share: scratch tables, and bounds of what Python workers get."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..scratch import drop_table, new_path, read_text, shared_folder, write_table, write_text

__all__ = ["drop_table", "new_path", "release", "read_text", "shared_folder", "small_batches", "type_of", "write_table", "write_text"]

#: Bounds of a batch of rows that a Python worker gets.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python workers at a time, by bytes and by rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the shuffle files of finished steps. The cleaner goes
    by what the driver no longer refers to, which takes a moment to be known."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
