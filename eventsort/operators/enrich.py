"""The effective time of a registry row, by precedence of its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exif_time, filename_time
from ..functions.text import stem

#: The transient column that clustering needs and no file gets.
TIME = "effective_time"


def enrich(registry: DataFrame) -> DataFrame:
    """Adds four text columns and the transient ``effective_time``.

    An embedded capture time (high, second), then a time (medium, second) or a date
    (medium, date) in the file name, then another recorded time (low, second), then
    nothing (low). ``registry`` has file_name and either the struct exif or its
    fields. Steps are columns of their own, so each text is parsed once."""
    field = (lambda f: F.col(f"exif.{f}")) if "exif" in registry.columns else F.col
    value, source = field("created_at"), field("created_at_source")
    rows = registry.withColumns({"__local": exif_time.local_of(value), "__offset": exif_time.offset_of(value), "__stem": stem(F.col("file_name"))})
    rows = rows.withColumns({"__recorded": exif_time.time_struct(F.col("__local"), F.col("__offset")), "__second": filename_time.second_of(F.col("__stem"))})
    rows = rows.withColumn("__noon", F.when(F.col("__second").isNull(), filename_time.noon_of(F.col("__stem"))))
    recorded, embedded = F.col("__recorded"), F.coalesce(field("created_at_is_embedded"), F.lit(False))
    rank = F.when(embedded & recorded.isNotNull(), 1).when(F.col("__second").isNotNull(), 2).when(F.col("__noon").isNotNull(), 3).when(~embedded & recorded.isNotNull(), 4).otherwise(5)
    rows = rows.withColumn("__rank", rank)
    k = F.col("__rank")
    named = exif_time.time_struct(F.when(k == 2, F.col("__second")).otherwise(F.col("__noon")), F.lit(0))
    rows = rows.withColumn(TIME, F.when(k.isin(1, 4), recorded).when(k.isin(2, 3), named))
    found = F.struct(
        TIME,
        exif_time.iso(F.col(TIME)).alias("effective_timestamp"),
        F.when(k.isin(1, 4), source).when(k == 2, "FilenameDateTime").when(k == 3, "FilenameDate").alias("effective_timestamp_source"),
        F.when(k == 1, "high").when(k.isin(2, 3), "medium").otherwise("low").alias("effective_timestamp_confidence"),
        F.when(k == 3, "date").when(k < 5, "second").alias("effective_timestamp_precision"),
    )
    # a generator of one row: filters on the time stay above it, else the optimiser
    # would copy all of the expressions above into them
    return rows.select(*registry.columns, F.inline(F.array(found)))


def event_day(time: Column) -> Column:
    """The local day, or ``missing``."""
    return F.coalesce(F.date_format(time["local"], "yyyy-MM-dd"), F.lit("missing"))
