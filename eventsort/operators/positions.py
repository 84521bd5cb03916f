"""Places in a total order, without a window over the table or over a frequent key.

Rows are dealt by ranges of the order, sorted within and written once; a row's place
is then its place in its range and the rows of the ranges before, of which there are
as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import new_path, write_table

#: Rows of a key that one window may hold.
HOT_ROWS = 100_000
#: The number of a row's range, and its place in it, from 0.
PART, ROW = "__part", "__row"


def dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` in written ranges of ``order``, whose columns tell all rows apart, with PART and ROW."""
    number = F.monotonically_increasing_id()  # the partition, then 33 bits of the row's place in it
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(ready.withColumns({PART: F.shiftright(number, 33).cast("int"), ROW: number.bitwiseAND(F.lit((1 << 33) - 1))}), new_path(rows.sparkSession, "dealt"))


def running(column: str, by: Sequence[str], keys: Sequence[str] = ()) -> Column:
    """The sum of ``column`` over the rows before, for small tables."""
    w = Window.partitionBy(*keys).orderBy(*by) if keys else Window.orderBy(*by)
    return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def positions(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``, 1 for the first row, to written ``rows``."""
    stored = dealt(rows, order)
    before = stored.groupBy(PART).agg(F.count(F.lit(1)).alias("__n")).select(PART, running("__n", [PART]).alias("__before"))
    placed = stored.join(F.broadcast(before), PART)  # one row a partition
    return placed.withColumn(out, F.col("__before") + F.col(ROW) + 1).drop(PART, ROW, "__before")


def turns(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: a row's place, from 1, among those of its ``keys``.

    Keys of few rows are windows. Rows of keys with more than ``HOT_ROWS`` are placed
    in one order of them all, less the place of the key's first."""
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if (counts.agg(F.max("__n")).first()[0] or 0) <= HOT_ROWS:
        return rows.withColumn(out, within)
    same = lambda right: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(right[f"__k{j}"]) for j, k in enumerate(keys)))
    named = [F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)]
    hot = counts.where(F.col("__n") > HOT_ROWS).select(*named)
    placed = positions(rows.join(hot, same(hot), "left_semi"), [*keys, *order], "__place")
    first = placed.groupBy(*named).agg(F.min("__place").alias("__first"))
    far = placed.join(first, same(first)).withColumn(out, F.col("__place") - F.col("__first") + 1).select(*rows.columns, out)
    return rows.join(hot, same(hot), "left_anti").withColumn(out, within).unionByName(far)
