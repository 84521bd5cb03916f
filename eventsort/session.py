"""A Spark session with what the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Speculation is off: two tasks must never copy or move the same file.
CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.speculation": "false", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "eventsort", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=CONF | conf).getOrCreate()
