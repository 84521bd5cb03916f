"""Connected components of large edge tables, by alternating star contraction.

Each round replaces a node's larger neighbours' links by links to its smallest
neighbour, then the same for smaller neighbours. Rounds are written to the shared
folder, which ends their lineage; only counts reach the driver. A table that is
already a set of stars takes no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, new_path, write_table


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents or a parent that has one itself."""
    children = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    if not children.where("n > 1").isEmpty():
        return True
    return not edges.select(F.col("a").alias("b")).join(children, "b", "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    pairs = linked.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
    return pairs.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long); label: the smallest node of its component."""
    spark = edges.sparkSession
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    path = new_path(spark, "edges")
    now = write_table(ordered, path)
    while _unfinished(now):
        new = new_path(spark, "edges")
        now = write_table(_small_star(_large_star(now).distinct()), new)
        drop_table(spark, path)
        path = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
