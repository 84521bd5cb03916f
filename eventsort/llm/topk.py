"""Exact top-k inner products by the threshold algorithm.

Candidates are dealt to blocks of bounded size by the component that is largest, so
that rows of a block point the same way, and within that by hash. In a block every
dimension has a list of its rows sorted by value. A query walks all lists at once from
the end that its sign prefers; rows that come up are scored in full; the sum of what
the lists show at the present depth bounds the score of every row not yet seen, and
the walk stops once that bound is below the k-th best score (equal is not enough,
since ties go to the smaller id).

A query first walks its *home* block, that of its own largest component. The k-th
score there is its floor: in another block it walks only if the block's largest
components allow a score that is not below the floor, and stops once the bound falls
below it. Blocks' results are ranked together.

Queries meet candidates block by block: a task holds one block of candidates and
one of queries, never all of either. Scores are integers: components are
floor(scale * x). They are computed exactly; beyond 64 bits they saturate.

Of equal vectors only the ``k`` + 1 smallest ids are candidates: a query can use ``k``
of them, and one may be its own. Of equal rows ``k`` are.

Cases: vectors that are null, hold null or non-finite components or have no id
take no part; vectors of different lengths don't meet; a query does not find rows
of its own id; repeated rows are candidates each; a repeated query is answered
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .store import new_path, write_table

#: Candidates and queries that a task holds, about; depth of the first step of a walk.
BLOCK_ROWS, QUERY_ROWS, STEP = 8_192, 2_048, 8

_OUT = "query_id long, query_key long, vec_id long, score long"


class SortedLists:
    """A block of rows with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, 0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no row's score with each query exceeds."""
        return np.maximum(queries, 0) @ self.sorted[-1] + np.minimum(queries, 0) @ self.sorted[0]

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``k`` rows whose id is not ``own``; rows that score below ``floor`` may lack."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        depth, step = 0, STEP
        while depth < n:
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[n - to : n - depth, up]] = True
            new[self.order[depth:to, down]] = True
            if not len(up) and not len(down):
                new[:] = True
                to = n
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            at = at[self.ids[at] != own]
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.rows[at] @ query])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            bound = (self.sorted[n - to, up] * query[up]).sum() + (self.sorted[to - 1, down] * query[down]).sum()
            if bound < floor or (len(ids) == k and bound < scores.min()):
                break
            depth, step = to, step * 2
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of the rows are exact."""
    top = lambda x: int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    return np.float64 if top(a) * top(b) * max(1, a.shape[1]) < 2**53 else object


def _answer(k: int):
    def answer(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows, asked = _matrix(candidates.column("v")), _matrix(queries.column("v"))
        out: list[tuple[int, int, int, int]] = []
        if len(rows) and len(asked):
            kind = _exact(rows, asked)
            copies = candidates.column("copies").to_numpy()
            lists = SortedLists(np.repeat(candidates.column("vec_id").to_numpy(), copies), np.repeat(rows, copies, axis=0).astype(kind))
            asked = asked.astype(kind)
            floors = [-np.inf if x is None else x for x in queries.column("floor").to_pylist()]
            bounds = lists.bounds(asked).tolist()
            for own, key, query, floor, bound in zip(queries.column("vec_id").to_pylist(), queries.column("key").to_pylist(), asked, floors, bounds, strict=True):
                if bound >= floor:
                    ids, scores = lists.top(query, own, k, floor)
                    out += [(own, key, i, min(2**63 - 1, max(-(2**63), int(s)))) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if s >= floor]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_key", "vec_id", "score"), columns, strict=True)})

    return answer


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v, key): usable rows with floor(scale * x) as 64-bit integers."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.xxhash64(v).alias("key"))


def _axis() -> Column:
    """The number of the largest component by size; below zero if that is negative. 0 for no components."""
    sizes = F.transform("v", F.abs)
    at = F.array_position(sizes, F.array_max(sizes)).cast("int")
    return F.when(F.size("v") == 0, 0).otherwise(F.when(F.try_element_at("v", at) < 0, -at).otherwise(at))


def _blocks(counts: Sequence[Row]) -> list[tuple[int, int, int, int]]:
    """(dims, axis, first block, number of blocks): axes with few rows share a block."""
    out, block, dims, held = [], -1, None, 0
    for r in sorted(counts, key=lambda r: (r["dims"], r["axis"])):
        many = 1 + r["n"] // BLOCK_ROWS
        if many > 1 or r["dims"] != dims or held + r["n"] > BLOCK_ROWS:
            out.append((r["dims"], r["axis"], block + 1, many))
            block, held = block + many, r["n"] if many == 1 else BLOCK_ROWS
        else:
            out.append((r["dims"], r["axis"], block, 1))
            held += r["n"]
        dims = r["dims"]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows, or all if
    there are fewer; ties to the smaller id. ``is_query``: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    counted = rows.groupBy("vec_id", "key").agg(F.any_value("v").alias("v"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    few = F.row_number().over(Window.partitionBy("key", "v").orderBy("vec_id"))
    placed = lambda df: df.select("*", F.size("v").alias("dims"), _axis().alias("axis"))
    path = new_path(spark, "vectors")
    candidates = write_table(placed(counted.withColumn("few", few).where(F.col("few") <= k + 1).drop("few")), path)
    # two rows for each number of components and component, however many vectors there are
    axes = _blocks(candidates.groupBy("dims", "axis").agg(F.count(F.lit(1)).alias("n")).collect())
    plan = F.broadcast(spark.createDataFrame(axes, "dims int, axis int, first int, many int"))
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id", "key"), F.col("many").cast("long"))).cast("int")
    asked = placed(rows.where(is_query).dropDuplicates(["vec_id", "key"])).join(plan, ["dims", "axis"], "left")
    # a query is a candidate of others, or equal to one, so its own component has a block
    asked = write_table(asked.select("vec_id", "v", "key", "dims", block.alias("home"), F.lit(None).cast("long").alias("floor")), new_path(spark, "queries"))
    dealt = candidates.join(plan, ["dims", "axis"]).select("vec_id", "v", "copies", "dims", block.alias("block"))

    def meet(queries: DataFrame, blocks: Column, parts: Column, part: Column) -> DataFrame:
        left = dealt.select("*", F.explode(parts).alias("part"))
        right = queries.select("*", part.alias("part"), F.explode(blocks).alias("block"))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_answer(k), _OUT)

    # a block is the home of as many queries as of its rows are, or of more if they are equal
    counts = asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    parts, at_home = (1 + (counts[c] or 0) // QUERY_ROWS for c in ("all", "most"))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "key"), F.lit(n)).cast("int")
    home = write_table(meet(asked, F.array("home"), F.sequence(F.lit(0), F.lit(at_home - 1)), number(at_home)), new_path(spark, "home"))
    best = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    ranked = lambda found: found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if all(first + many <= 1 for _, _, first, many in axes):
        return ranked(home)  # there is one block
    floors = home.groupBy("query_id", "query_key").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = asked.drop("floor").join(floors.select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), "floor"), ["vec_id", "key"], "left")
    # blocks of vectors of one length have consecutive numbers
    spans = plan.groupBy("dims").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("many") - 1).alias("high"))
    every = F.filter(F.sequence("low", "high"), lambda b: b != F.col("home"))
    away = meet(known.join(F.broadcast(spans), "dims"), every, F.sequence(F.lit(0), F.lit(parts - 1)), number(parts))
    return ranked(home.union(away))
