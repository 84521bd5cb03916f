"""Best-fit packing of token sequences by non-negative least squares over patterns.

1. Documents become pieces of at most ``capacity`` tokens (one written table).
2. The histogram of piece lengths, at most ``capacity`` rows whatever the input,
   goes to the driver. ``plan`` enumerates patterns of two and three lengths that
   fill a sequence exactly, fits repeat counts to the histogram by non-negative
   least squares, rounds them, and packs what is left best-fit decreasing. All
   of that works on counts of lengths, never on single pieces.
3. Each piece gets its number among the pieces of its length: a running number
   within (length, bucket) plus the bucket's offset. A length has a bucket for every
   ``BUCKET_ROWS`` of its pieces and they are dealt by a running number, so that no
   task ever holds all pieces of a frequent length, not even of one document that
   is repeated. The number picks the piece's place.

Cases: a null text counts as empty and is a piece of its end token alone; null
ids stay null; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import is_low, load
from .store import new_path, small_batches, type_of, write_table
from .textnum import give_back

#: Pieces that one bucket of a length holds, about.
BUCKET_ROWS = 5_000
#: Rounds of fitting and rounding, and gradient steps in each.
ROUNDS, STEPS = 3, 250


def cuts(length: int, capacity: int) -> list[int]:
    """Where pieces begin: only the first may be shorter than ``capacity``."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of present lengths that add up to ``capacity``."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = capacity - a - b
    ok = (c >= 0) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes ``sum_p x_p * pattern_p`` close to ``counts``, by
    accelerated projected gradient steps. ``counts[0]`` has no say."""
    n, width = len(patterns), len(counts)
    real = patterns > 0

    def usage(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], x * real[:, k], width) for k in range(3))

    probe = np.ones(n)
    for _ in range(12):  # the largest eigenvalue, by powers
        probe = sum(usage(probe)[patterns[:, k]] * real[:, k] for k in range(3))
        top = np.linalg.norm(probe)
        probe /= top
    x = y = np.zeros(n)
    pace = 1.0
    for _ in range(steps):
        miss = usage(y) - counts
        step = sum(miss[patterns[:, k]] * real[:, k] for k in range(3))
        new = np.maximum(0, y - step / (1.05 * top))
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = new + (pace - 1) / quicker * (new - x)
        x, pace = new, quicker
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts of lengths: (lengths of a sequence, how many such)."""
    groups: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r, g in groups.items() if r >= length and g), default=None)
            if room is None:
                groups.setdefault(capacity, []).append([(), left])
                continue
            held, many = groups[room].pop()
            each = room // length
            full = min(left // each, many)
            take = each if full else left
            used = full or 1
            if many > used:
                groups[room].append([held, many - used])
            groups.setdefault(room - take * length, []).append([held + (length,) * take, used])
            left -= take * used
    return [(held, many) for g in groups.values() for held, many in g if held]


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold exactly the pieces of ``histogram``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, many in histogram.items():
        counts[length] += many
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for _ in range(ROUNDS):
        patterns = exact_patterns(np.flatnonzero(counts), capacity)
        if not len(patterns):
            break
        x = fit(patterns, counts.astype(float))
        order = np.argsort(-x, kind="stable")
        for p, much in zip(patterns[order].tolist(), x[order].tolist(), strict=True):
            if much < 0.3:
                break
            lengths = [length for length in p if length]
            most = min(int(counts[length]) // lengths.count(length) for length in lengths)
            if many := min(most, max(1, int(much + 0.5))):
                out.append((tuple(lengths), many))
                for length in lengths:
                    counts[length] -= many
    return out + best_fit(counts, capacity)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal[, ids]) of every document's token ids and ``end_id``.

    ``ids``: the ids themselves as little-endian unsigned 32-bit numbers; ``deal``: a
    number that spreads pieces, also equal ones."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        deal = TaskContext.get().partitionId() * 1_000_003
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            low = is_low(batch.column(1))
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (bpe.encode(text, low) if text else b"") + end
                at = [*cuts(len(ids) // 4, capacity), len(ids) // 4]
                for k in range(len(at) - 1):
                    part = ids[4 * at[k] : 4 * at[k + 1]]
                    row.append(i)
                    piece.append(k)
                    start.append(at[k])
                    length.append(at[k + 1] - at[k])
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(deal, deal + len(row)))]
            deal += len(row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)
        bpe.ids.shrink()
        give_back()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {type_of(rows, 'doc_id')}, piece int, start long, length long, ids_crc32 long, deal long" + ", ids binary" * keep_ids)


def place(table: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a *written* table of pieces, and drops deal.

    Numbers are given by content, so that a task that runs again gives the same."""
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sequence, free, slots = 0, dict.fromkeys(histogram, 0), []
    for lengths, many in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, free[length], sequence, offset))
            free[length] += many
            offset += length
        sequence += many
    slots.sort()
    slot = np.array(slots or [(0, 0, 0, 0)], np.int64)
    key = (slot[:, 0] << 46) + slot[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            number = batch.column(names.index("number")).to_numpy()
            length = batch.column(names.index("length")).to_numpy()
            at = np.searchsorted(key, (length << 46) + number, "right") - 1
            arrays = [batch.column(i) for i, n in enumerate(names) if n != "number"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(slot[at, 2] + number - slot[at, 1]), pa.array(slot[at, 3])], names=[n for n in names if n != "number"] + ["sequence_id", "offset"])

    buckets = [(length, 1 + n // BUCKET_ROWS) for length, n in histogram.items()]  # ``capacity`` rows at most
    many = F.broadcast(table.sparkSession.createDataFrame(buckets, "length long, buckets long"))
    bucketed = table.join(many, "length").withColumn("bucket", F.pmod(F.xxhash64("deal"), F.col("buckets")))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "deal"))
    numbered = bucketed.withColumn("within", within).join(offsets, ["length", "bucket"])
    kept = [f for f in table.schema if f.name != "deal"]
    ready = numbered.select(*[f.name for f in kept], (F.col("before") + F.col("within") - 1).alias("number"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return ready.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: (doc_id, piece, start, length,
    ids_crc32[, ids], sequence_id, offset). Offsets leave no gap in a sequence."""
    small_batches(docs.sparkSession)
    cut = pieces(docs, vocabulary, end_id, capacity, keep_ids)
    return place(write_table(cut, new_path(docs.sparkSession, "pieces")), capacity)
