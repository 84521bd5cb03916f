"""Substring deduplication with a log-structured fingerprint index.

A fingerprint is the 64-bit hash of ``width`` consecutive words; a second, independent
hash of the same words, of 32 bits, goes with it. The index is a set of immutable
runs; a run holds, for each bucket of hashes, the sorted fingerprints of some past
batches. ``FingerprintIndex.add`` takes a batch of fingerprints:

1. they are combined where they are made: of the documents that a task holds at a
   time, a window goes to the index for the smallest id only, and the others know
   already that it is repeated;
2. in each bucket the batch's sorted fingerprints are merge-joined with the sorted
   runs and with each other: a window is repeated if it is in a run or if a
   document of the batch with a smaller id has it;
3. a match is verified by the second hash; without it, it is none;
4. new fingerprints become a run. Runs have levels: ``fan_in`` runs of a level are
   compacted into one of the next, so a fingerprint is rewritten once a level.

An index with a ``folder`` outlives its session: ``FingerprintIndex.open`` reads its
manifest, ``add_documents`` deduplicates one more batch against all before.

``rewrite`` takes out the words that repeated windows cover. Batches must come in
the order of ids for "smaller id" to hold across batches; ``deduplicate`` cuts a
table into such batches.

Most windows of a table occur in one document only. ``deduplicate`` leaves out
those that cannot repeat before it fills its index: a window's *minimizer* is the
least hash of its ``ANCHOR``-word parts; equal windows have equal minimizers, and
neighbours mostly share theirs, so a table of minimizers, a fifth the size, tells
each document which of its minimizers another document has too.

Bounds: a bucket holds about ``BUCKET_HASHES`` different hashes, as their number
follows the input; of a passage that very many documents have it holds an entry for
every ``COMBINE`` windows of a task, not for every document. A document's repeated
windows are gathered with that document only. Nothing but sizes and batch borders
reaches the driver.

Cases: null and empty texts and those shorter than ``width`` words lose nothing;
rows with a null id are neither compared nor cut; rows that repeat an id don't
count against each other, and are told apart by a hash of their text; an empty table
gives an empty table; only columns named in ``carry`` are passed on, and none may be
called ``__same``. Ids are integers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_table, new_path, read_text, release, small_batches, type_of, write_table, write_text
from .textnum import Words, blob_values, chunks, give_back, mix, ngram_hashes

#: Hashes that a bucket holds at most, about; bytes of text to a word, about, and words to
#: a minimizer or to a window whose minimizer is shared.
BUCKET_HASHES, WORD_BYTES, SPARSE = 2_000_000, 6, 5
#: Words of the parts whose least hash is a window's minimizer.
ANCHOR = 5
#: Hashes that a task combines at a time.
COMBINE = 500_000

#: A hash of id and text: rows that share an id are told apart by it.
SAME = "__same"
_IN = "kind string, batch int, bucket int, doc_id long, same long, docs binary, sames binary, counts binary, hashes binary, checks binary"
_OUT = "bucket int, doc_id long, same long, hashes binary, checks binary, kind string"
_CUT = "kind string, doc_id long, same long, hashes binary"

def _valid(words: Words, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that lie in one text, and their text."""
    text = np.repeat(np.arange(rows), np.diff(words.first))
    starts = np.flatnonzero(text[: max(0, len(text) - width + 1)] == text[width - 1 :])
    return starts, text[starts]


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minimizer of every window."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part = min(ANCHOR, width)
    least, span = ngram_hashes(hashes, part, 3), 1
    while span < width - part + 1:
        step = min(span, width - part + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least[:n]


def _fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    return ngram_hashes(hashes, width, 5)


def _checks(hashes: np.ndarray, width: int) -> np.ndarray:
    """The second hash of every window."""
    return (mix(ngram_hashes(hashes, width, 7)) >> np.uint64(32)).astype(np.uint32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket that grows along the hash; twice as many buckets cut each in two."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of ``values`` cut at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _ends(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys end."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[:-1] |= k[1:] != k[:-1]
    change[-1] = True
    return np.flatnonzero(change) + 1


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends


class _Documents:
    """Hashes of some documents, sorted by hash and then by document; a document (id,
    same) has each hash once. Documents are numbered in the order of ids."""

    def __init__(self, ids: np.ndarray, same: np.ndarray, doc: np.ndarray, h: np.ndarray, check: np.ndarray):
        by = np.lexsort((same, ids))
        new = np.ones(len(by), bool)
        new[1:] = (ids[by][1:] != ids[by][:-1]) | (same[by][1:] != same[by][:-1])
        number = np.empty(len(by), np.int32)
        number[by] = np.cumsum(new) - 1
        self.ids, self.same = ids[by][new], same[by][new]
        doc = number[doc]
        order = np.lexsort((doc, h))
        doc, h, check = doc[order], h[order], check[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.h, self.check = doc[new], h[new], check[new]

    @property
    def first(self) -> np.ndarray:
        """Of each entry, the first with its hash."""
        ends = _ends(self.h)
        return np.repeat(_starts(ends), np.diff(np.r_[0, ends]))

    def shared(self) -> np.ndarray:
        """Which entries' hashes more than one id has."""
        ends = _ends(self.h)
        several = self.ids[self.doc[_starts(ends)]] != self.ids[self.doc[ends - 1]] if len(ends) else np.zeros(0, bool)
        return np.repeat(several, np.diff(np.r_[0, ends]))

    def by_document(self, which: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids and sames of the documents of some entries, and the hashes of each."""
        doc, h = self.doc[which], self.h[which]
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        ends = _ends(doc)
        of = doc[ends - 1] if len(ends) else np.zeros(0, np.int64)
        return pa.array(self.ids[of]), pa.array(self.same[of]), _blobs(h, ends)

    def cuts(self, which: np.ndarray, buckets: int) -> pa.RecordBatch:
        """Rows of ``_IN`` of kind ``cut``: hashes by document, spread over buckets."""
        ids, same, hashes = self.by_document(which)
        n = len(ids)
        none = pa.nulls(n, pa.binary())
        spread = pa.array((same.to_numpy() % buckets).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(["cut"] * n, pa.string()), pa.array([-1] * n, pa.int32()), spread, ids, same, none, none, none, hashes, none], names=_names(_IN))

    def blocks(self, which: np.ndarray, buckets: int, borders: np.ndarray) -> pa.RecordBatch:
        """Rows of ``_IN`` of kind ``in``: entries by batch and bucket, document by document."""
        doc, h, check = self.doc[which], self.h[which], self.check[which]
        batch, bucket = np.searchsorted(borders, self.ids, "left")[doc], _bucket(h, buckets)
        order = np.lexsort((doc, bucket, batch))
        doc, h, check, batch, bucket = (x[order] for x in (doc, h, check, batch, bucket))
        runs = _ends(batch, bucket, doc)  # of one document
        at = runs - 1
        cuts = _ends(batch[at], bucket[at]) if len(at) else at
        ends = runs[cuts - 1] if len(cuts) else cuts
        n, none = len(cuts), pa.nulls(len(cuts), pa.int64())
        of, counts = doc[at], np.diff(np.r_[0, runs]).astype(np.int32)
        head = [pa.array(["in"] * n, pa.string()), pa.array(batch[ends - 1] if n else [], pa.int32()), pa.array(bucket[ends - 1] if n else [], pa.int32()), none, none]
        return pa.RecordBatch.from_arrays([*head, _blobs(self.ids[of], cuts), _blobs(self.same[of], cuts), _blobs(counts, cuts), _blobs(h, ends), _blobs(check, ends)], names=_names(_IN))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _combined(batches: Iterator[pa.RecordBatch], hashes: Callable, emit: Callable[[_Documents], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``emit`` of the documents of every ``COMBINE`` hashes. ``hashes``: (text within the
    chunk, hashes, second hashes) of a chunk (batch, first row, row after the last, words)."""
    parts: list[tuple] = []
    docs = held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield from emit(_Documents(*map(np.concatenate, zip(*parts, strict=True))))

    for batch in batches:
        ids, same = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i, j, words in chunks(batch.column(1)):
            doc, h, check = hashes(batch, i, j, words)
            parts.append((ids[i:j], same[i:j], doc + docs, h, check))
            docs, held = docs + j - i, held + len(h)
            if held >= COMBINE:
                yield from flush()
                parts, docs, held = [], 0, 0
    yield from flush()
    give_back()


def _repeats(found: _Documents, buckets: int, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What of a task's windows the index must see, and what is known to be repeated."""
    ids, first = found.ids[found.doc], found.first
    repeated = (ids > ids[first]) & (found.check == found.check[first])
    yield found.blocks(~repeated, buckets, borders)
    if repeated.any():
        yield found.cuts(repeated, buckets)


def fingerprints(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """All fingerprints of a batch (doc_id long, text, __same), in blocks."""
    none = np.zeros(0, np.int64)

    def hashes(batch: pa.RecordBatch, i: int, j: int, words: Words) -> tuple:
        at, doc = _valid(words, width, j - i)
        return doc, _fingerprints(words.hash, width)[at], _checks(words.hash, width)[at]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(batches, hashes, lambda found: _repeats(found, buckets, none))

    return docs.select("doc_id", "text", SAME).mapInArrow(emit, _IN)


def _minimizer_blocks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    none = np.zeros(0, np.int64)

    def hashes(batch: pa.RecordBatch, i: int, j: int, words: Words) -> tuple:
        at, doc = _valid(words, width, j - i)
        h = _minimizers(words.hash, width)[at]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return doc[new], h[new], np.zeros(int(new.sum()), np.uint32)

    def send(found: _Documents) -> Iterator[pa.RecordBatch]:
        shared = found.shared()  # known here: one entry speaks for all
        yield found.blocks(~shared | (found.first == np.arange(len(shared))), buckets, none)
        if shared.any():
            yield found.cuts(shared, buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(batches, hashes, send)

    return docs.select("doc_id", "text", SAME).mapInArrow(emit, _IN)


def _entries(block: pa.Table) -> _Documents:
    """The entries of one bucket's blocks."""
    counts = blob_values(block.column("counts"), np.int32)
    doc = np.repeat(np.arange(len(counts)), counts)
    return _Documents(blob_values(block.column("docs"), np.int64), blob_values(block.column("sames"), np.int64), doc, blob_values(block.column("hashes"), np.uint64), blob_values(block.column("checks"), np.uint32))


def _shared(block: pa.Table) -> pa.Table:
    """One bucket: the hashes that more than one id has, by document; what was known before passes through."""
    kind = block.column("kind")
    known = block.filter(pc.equal(kind, "cut")).select(["doc_id", "same", "hashes"])
    found = _entries(block.filter(pc.equal(kind, "in")))
    made = pa.table(dict(zip(("doc_id", "same", "hashes"), found.by_document(found.shared()), strict=True)))
    give_back()
    return pa.concat_tables([made, known], promote_options="default")


def repeatable(docs: DataFrame, width: int, buckets: int, sparse_buckets: int, borders: Sequence[int]) -> DataFrame:
    """Fingerprints, in blocks by batch, of the windows whose minimizer occurs in
    more than one document. ``borders``: the last id of every batch but the last."""
    ends = np.array(borders, np.int64)

    def hashes(batch: pa.RecordBatch, i: int, j: int, words: Words) -> tuple:
        anchors = batch.column(3).slice(i, j - i).to_pylist()
        at, doc = _valid(words, width, j - i)
        least = _minimizers(words.hash, width)[at]
        keep = np.zeros(len(at), bool)
        cuts = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
        for k, own in enumerate(anchors):
            part = slice(cuts[k], cuts[k + 1])
            keep[part] = np.isin(least[part], np.frombuffer(b"".join(own), np.uint64))
        at, doc = at[keep], doc[keep]
        return doc, _fingerprints(words.hash, width)[at], _checks(words.hash, width)[at]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(batches, hashes, lambda found: _repeats(found, buckets, ends))

    found = _minimizer_blocks(docs, width, sparse_buckets).groupBy("bucket").applyInArrow(_shared, "doc_id long, same long, hashes binary")
    anchors = found.groupBy("doc_id", F.col("same").alias(SAME)).agg(F.collect_set("hashes").alias("anchors"))
    return docs.join(anchors, ["doc_id", SAME]).select("doc_id", "text", SAME, "anchors").mapInArrow(emit, _IN)


def _in_run(h: np.ndarray, check: np.ndarray, run_h: np.ndarray, run_check: np.ndarray) -> np.ndarray:
    """Which (h, check), sorted, are in a sorted run: found by the first, verified by the second."""
    at = np.searchsorted(run_h, h, "left")
    out = np.zeros(len(h), bool)
    open_ = np.arange(len(h))
    while len(open_):
        open_ = open_[at[open_] < len(run_h)]
        open_ = open_[run_h[at[open_]] == h[open_]]
        out[open_] = run_check[at[open_]] == check[open_]
        open_ = open_[~out[open_]]
        at[open_] += 1
    return out


def _merge(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """One bucket: repeated windows by document (kind ``cut``), and the new run."""
    bucket = (batch if batch.num_rows else runs).column("bucket")[0].as_py()
    found = _entries(batch)
    order = np.lexsort((found.doc, found.check, found.h))
    h, check = found.h[order], found.check[order]
    ends = _ends(h, check)
    first = _starts(ends)
    known, known_check = h[first], check[first]
    old = np.zeros(len(known), bool)
    for run_h, run_check in zip(runs.column("hashes").to_pylist(), runs.column("checks").to_pylist(), strict=True):
        old |= _in_run(known, known_check, np.frombuffer(run_h, np.uint64), np.frombuffer(run_check, np.uint32))
    ids, sizes = found.ids[found.doc[order]], np.diff(np.r_[0, ends])
    which = np.zeros(len(h), bool)
    which[order] = np.repeat(old, sizes) | (ids > np.repeat(ids[first], sizes))
    ids, same, hashes = found.by_document(which)
    n = len(ids)
    out = pa.table({"bucket": pa.array([bucket] * n, pa.int32()), "doc_id": ids, "same": same, "hashes": hashes, "checks": pa.nulls(n, pa.binary()), "kind": pa.array(["cut"] * n, pa.string())})
    give_back()
    return pa.concat_tables([out, _run(bucket, known[~old], known_check[~old])])


def _run(bucket: int, h: np.ndarray, check: np.ndarray) -> pa.Table:
    none = pa.array([None], pa.int64())
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "doc_id": none, "same": none, "hashes": pa.array([h.tobytes()], pa.binary()), "checks": pa.array([check.tobytes()], pa.binary()), "kind": pa.array(["run"], pa.string())})


def _compact(buckets: int):
    def compact(runs: pa.Table) -> pa.Table:
        """One bucket of some runs as one run, dealt to ``buckets`` buckets."""
        h, check = blob_values(runs.column("hashes"), np.uint64), blob_values(runs.column("checks"), np.uint32)
        order = np.lexsort((check, h))
        h, check = h[order], check[order]
        last = _ends(h, check) - 1
        h, check = h[last], check[last]
        to = _bucket(h, buckets)
        ends = _ends(to)
        return pa.concat_tables([_run(int(to[s]), h[s:e], check[s:e]) for s, e in zip(_starts(ends).tolist(), ends.tolist(), strict=True)] or [_run(0, h, check)])

    return compact


class FingerprintIndex:
    """Runs and cuts in the shared store, or under ``folder``, where a later session
    can ``open`` them."""

    def __init__(self, spark: SparkSession, width: int = 13, buckets: int = 32, fan_in: int = 2, folder: str | None = None):
        self.spark, self.width, self.buckets, self.fan_in, self.folder = spark, width, buckets, fan_in, folder
        self.runs: list[tuple[int, str]] = []  # (level, path), oldest first
        self.cuts: list[str] = []
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that a session before left under ``folder``."""
        kept = json.loads(read_text(spark, f"{folder}/manifest.json"))
        index = cls(spark, kept["width"], kept["buckets"], kept["fan_in"], folder)
        index.runs, index.made = [(level, f"{folder}/{name}") for level, name in kept["runs"]], kept["made"]
        return index

    def save(self) -> None:
        """Writes the manifest. A batch whose manifest was not written is as if it had not come."""
        kept = {"width": self.width, "buckets": self.buckets, "fan_in": self.fan_in, "made": self.made, "runs": [(level, path.rsplit("/", 1)[1]) for level, path in self.runs]}
        write_text(self.spark, f"{self.folder}/manifest.json", [json.dumps(kept)])

    def _path(self, name: str) -> str:
        self.made += 1
        return f"{self.folder}/{name}-{self.made:06d}" if self.folder else new_path(self.spark, name)

    def _read_runs(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _OUT)
        parts = [self.spark.read.schema(_OUT).parquet(p).where(F.col("kind") == "run") for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def add(self, blocks: DataFrame, last: bool = False) -> list[str]:
        """Finds what a batch of fingerprints, in *written* blocks, repeats, and returns the
        tables that tell. ``last``: nothing comes after, so its run need not be kept."""
        path = self._path("found")
        batch = blocks.where("kind = 'in'").groupBy("bucket")
        found = batch.cogroup(self._read_runs([p for _, p in self.runs]).groupBy("bucket")).applyInArrow(_merge, _OUT)
        (found.where(F.col("kind") == "cut") if last else found).write.mode("overwrite").partitionBy("kind").parquet(path)
        self.cuts.append(path)
        old: list[str] = []
        if not last:
            self.runs.append((0, path))
            old = self.compact()
        if self.folder:
            self.save()
        for p in old:  # only once no manifest names them
            drop_table(self.spark, f"{p}/kind=run")
        release(self.spark)
        return [path]

    def compact(self) -> list[str]:
        """Merges ``fan_in`` runs of a level into one of the next; returns what is no longer needed."""
        old: list[str] = []
        level = 0
        while any(of >= level for of, _ in self.runs):
            some = [p for of, p in self.runs if of == level]
            if len(some) >= self.fan_in:
                path = self._path("run")
                self._read_runs(some).groupBy("bucket").applyInArrow(_compact(self.buckets), _OUT).write.mode("overwrite").partitionBy("kind").parquet(path)
                self.runs = [r for r in self.runs if r[1] not in some] + [(level + 1, path)]
                old += some
            level += 1
        return old

    def drop_runs(self) -> None:
        for _, path in self.runs:
            drop_table(self.spark, f"{path}/kind=run")
        self.runs = []

    def repeated(self, tables: Sequence[str] | None = None) -> DataFrame:
        """(doc_id, __same, cuts): fingerprints of each document's repeated windows, from
        ``tables`` or of all batches of this session."""
        parts = [self.spark.read.schema(_CUT).parquet(p).where(F.col("kind") == "cut").select(*_names(_CUT)) for p in (self.cuts if tables is None else tables)]
        found = self.spark.createDataFrame([], _CUT)
        for p in parts:
            found = found.union(p)
        return found.groupBy("doc_id", F.col("same").alias(SAME)).agg(F.collect_set("hashes").alias("cuts"))

    def add_documents(self, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """``rewrite`` of one more batch, whose ids are larger than those before; all its
        fingerprints are kept for later batches."""
        small_batches(self.spark)
        rows = _rows(docs, carry)
        path = new_path(self.spark, "windows")
        blocks = write_table(fingerprints(rows.where("doc_id is not null"), self.width, self.buckets), path)
        return rewrite(rows, self.repeated([path, *self.add(blocks)]), self.width, carry)


def _removed(hashes: np.ndarray, cuts: list[bytes], width: int) -> np.ndarray:
    """Which words of a text the windows in ``cuts`` cover."""
    windows = np.isin(_fingerprints(hashes, width), np.frombuffer(b"".join(cuts), np.uint64))
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[: len(windows)] += windows
    edge[width : width + len(windows)] -= windows
    return np.cumsum(edge[:-1]) > 0


def _kept_text(data: bytes, start: np.ndarray, end: np.ndarray, removed: np.ndarray) -> bytes:
    """Runs of kept words as they stood, joined by a line break where one was between."""
    kept = ~removed
    first = np.flatnonzero(kept & np.r_[True, removed[:-1]])
    last = np.flatnonzero(kept & np.r_[removed[1:], True])
    out = b""
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        gap = b"" if not k else b"\n" if b"\n" in data[end[last[k - 1]] : start[a]] else b" "
        out += gap + data[start[a] : end[b]]
    return out


def rewrite(docs: DataFrame, repeated: DataFrame, width: int, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, text, n_words, n_removed, kept_sha256) of rows (doc_id, text, __same,
    *carry): texts without the words of repeated windows.

    A text that loses nothing stays as it is. ``kept_sha256``: of the kept words
    joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_words, n_removed, sha = [], [], []
            for k, cuts in enumerate(batch.column(2).to_pylist()):
                data = (texts[k] or "").encode()
                split = data.split()
                gone = 0
                if cuts:
                    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    removed = _removed(words.hash, cuts, width)
                    gone = int(removed.sum())
                    kept = b" ".join([w for w, r in zip(split, removed.tolist(), strict=True) if not r])
                    if gone:
                        texts[k] = _kept_text(data, words.start, words.end, removed).decode()
                else:
                    kept = b" ".join(split)
                n_words.append(len(split))
                n_removed.append(gone)
                sha.append(hashlib.sha256(kept).hexdigest())
            more = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", *carry, "text", "n_words", "n_removed", "kept_sha256"])

    joined = docs.join(repeated, ["doc_id", SAME], "left").select("doc_id", "text", "cuts", *carry)
    extra = "".join(f"{c} {type_of(docs, c)}, " for c in carry)
    return joined.mapInArrow(cut, f"doc_id long, {extra}text string, n_words long, n_removed long, kept_sha256 string")


def _rows(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return rows.withColumn(SAME, F.xxhash64("doc_id", "text"))


def deduplicate(docs: DataFrame, width: int = 13, batches: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """``rewrite`` of a whole table, indexed in ``batches`` ranges of ids."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, carry)
    known = rows.where("doc_id is not null").select("doc_id", "text", SAME)
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16 + size // WORD_BYTES // SPARSE // BUCKET_HASHES
    index = FingerprintIndex(spark, width, buckets)
    borders = sorted({int(x) for x in known.approxQuantile("doc_id", [(k + 1) / batches for k in range(batches - 1)], 0.01)}) if size and batches > 1 else []
    path = new_path(spark, "windows")
    repeatable(known, width, buckets, buckets, borders).write.partitionBy("kind", "batch").parquet(path)
    release(spark)
    blocks = spark.read.schema(_IN).parquet(path)
    for k in range(len(borders) + 1):
        index.add(blocks.where(F.col("batch") == k), last=k == len(borders))
    index.drop_runs()
    drop_table(spark, f"{path}/kind=in")
    return rewrite(rows, index.repeated([path, *index.cuts]), width, carry)
