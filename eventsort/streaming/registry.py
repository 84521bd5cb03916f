"""A registry that grows: new JSON lines are enriched as they come, and files whose
content was seen within the watermark are dropped. Event clustering needs whole
days and stays a batch step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.enrich import enrich


def registry_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.REGISTRY).json(path)


def new_files(registry: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Enriched rows, one for each content hash within ``watermark`` of arrival."""
    arrived = registry.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", watermark)
    return enrich(arrived.dropDuplicatesWithinWatermark(["hash_sha256"]))


def counts_by_source(enriched: DataFrame) -> DataFrame:
    source = F.coalesce("effective_timestamp_source", F.lit("missing")).alias("timestamp_source")
    return enriched.groupBy(source).agg(F.count(F.lit(1)).alias("files"))
