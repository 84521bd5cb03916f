"""N-gram Jaccard join with count-vector R-trees.

Texts become sets of 64-bit hashes of word n-grams; equal sets are one set from
then on. A pair links if its Jaccard similarity is at least ``percent`` / 100.

1. *Frequencies.* n-grams go to hash buckets, a chunk of documents at a time: those
   that a chunk has once with two bytes to say whose they are, those that it has
   more often once with their count, so that an n-gram of all documents is a few
   bytes a chunk. Those that occur more than once come back with their total. A set
   that has more than it may of n-grams that nothing else has
   (``size - ceil(size * percent / 100)``) has no link and leaves. Equal sets of one
   task go once; others are told apart from copies only where that matters.
2. *Cells.* A remaining set's n-grams are ordered rarest first, by totals over all
   documents. Linked sets share one among the first ``misses + 1`` of each (else
   their overlap is too small), so every link lies in the cell of some n-gram.
   Passages that many documents share come last in that order.
3. *R-tree.* n-grams are hashed into ``GROUPS`` groups; a set is the point of its
   group counts. In a cell an R-tree over the points finds, for a set, the others
   whose overlap can be large enough: it is at most the sum over groups of the
   smaller count, and for a node the sum with the node's largest counts. Sets
   that may link are united, and only a star of each united group is emitted. A
   cell that more than ``HOT_CELL`` sets may be in never is one table: its sets are
   united by way of the n-gram itself, chunk by chunk, and verified as others are.
4. *Verification.* United groups are the blocks. Sets of small blocks meet in one
   task, where R-trees again propose pairs, n-grams are intersected exactly, and
   linked sets are united; pairs that are already connected need no test. A block
   of more than ``PART_SETS`` sets or ``PART_BYTES`` bytes is cut into parts: each
   part first meets a few pivots of the block, which connects groups of near copies
   in linear work; pivots that a set links with both are one group. What links with no
   pivot then meets every part, and so does what links with one and is so close to a
   pivot of another group that a link across is possible, but for the largest group's.

No link is lost: each step drops only what cannot link. Nothing of the corpus is
collected; buckets, bins and parts are of bounded size as their number follows
the input. Work grows with the square only in the sets of one block that link with
none of its pivots, or are between two groups. Components span tasks by star contraction (``graph``).

Cases: null texts and texts without words have the empty set and link with
nothing, not even each other; a text with fewer words than ``width`` has its
whole word sequence as the only n-gram; rows that repeat, also with one id, are
in one component; a null id is never the smallest; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import drop_table, new_path, release, small_batches, type_of, write_table
from .textnum import Words, blob_values, chunks, give_back, mix, ngram_hashes, stream

#: n-grams a bucket holds, about; bytes of text to an n-gram, about.
BUCKET_GRAMS, GRAM_BYTES = 1_200_000, 6
#: n-grams to a row of a chunk, about; n-grams of a chunk, least and most; names that a task remembers.
ROW_GRAMS, LEAST_GRAMS, MOST_GRAMS, SEEN = 512, 100_000, 2_000_000, 1_000_000
#: Dimensions of the points; fan-out of the trees.
GROUPS, FAN = 32, 16
#: Sets in a bin of small blocks, about, and in a part of a large block; bytes of either.
BIN_SETS, PART_SETS, PART_BYTES = 500, 600, 32 << 20
#: Sets that an n-gram has before its cell counts as hot; pivots of a large block, at most.
HOT_CELL, PIVOTS = 20_000, 4

_U = np.uint64
_BLOCK = "kind string, key long, size long, a binary, b binary, c binary, d binary, e binary"


# --- sets ---------------------------------------------------------------------


def _sets(words: Words, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text that has words."""
    grams = ngram_hashes(words.hash, width, 13)
    for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a >= width:
            yield k, np.unique(grams[a : b - width + 1])
        elif b > a:
            yield k, ngram_hashes(words.hash[a:b], b - a, 20 + b - a)


def _signature(grams: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int(mix(mix(grams ^ _U(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + _U(len(grams)))[0] >> _U(1))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, sig, *others) of every row; sig is null where there are no words."""
    others = docs.columns[2:]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, _, words in chunks(batch.column(1), lower=True):
                for k, grams in _sets(words, width):
                    sizes[i + k], sigs[i + k] = len(grams), _signature(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sigs, pa.int64()), *batch.columns[2:]], names=["doc_id", "n_shingles", "sig", *others])

    return docs.mapInArrow(name, "doc_id long, n_shingles long, sig long" + "".join(f", {c} {type_of(docs, c)}" for c in others))


def _bytes(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _row(key: int, *blobs: bytes, kind: str = "", size: int = 0) -> tuple:
    return (kind, key, size, *blobs, *[None] * (5 - len(blobs)))


def _table(rows: Sequence[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "key", "size", *"abcde"), columns, types, strict=True)})


def _read(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return blob_values(table.column(column), kind)


def _cut(owner: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """Entries sorted by owner, then document: (owner, slice, documents, their counts)."""
    if not len(owner):
        return
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
    counts = np.diff(np.r_[first, len(owner)])
    own = owner[first]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ends = np.r_[at[1:], len(own)]
    to = np.r_[first, len(owner)]
    for s, e in zip(at.tolist(), ends.tolist(), strict=True):
        yield int(own[s]), slice(int(to[s]), int(to[e])), doc[first[s:e]], counts[s:e]


def _runs(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(owner, slice) of entries sorted by owner."""
    if not len(owner):
        return
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(owner)], strict=True):
        yield int(owner[s]), slice(s, e)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket that grows along the n-gram, so that sorted n-grams are sorted by bucket."""
    return (((grams >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _deal(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Sets, a chunk of documents at a time. ``grams`` rows for each bucket (size: the
    chunk, a: places in the chunk, b: n-grams that it has once, c: n-grams that it has
    more often, d: how often), and a ``names`` row (a: names, b: sizes, c and d as
    there but for all buckets, e: the places of c's n-grams).

    A chunk is the larger the more buckets there are, so rows do not get short. Its
    number is the task's and its own, so ``docs`` must come in the same order when a
    task runs again, as files and written tables do."""
    full = min(MOST_GRAMS, max(LEAST_GRAMS, buckets * ROW_GRAMS))

    def rows(chunk: int, names: list[int], sets: list[np.ndarray]) -> pa.Table:
        grams = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(grams)
        grams, doc = grams[order], doc[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        many = np.diff(np.r_[first, len(grams)])
        once = many == 1
        single, common, counts = first[once], grams[first[~once]], many[~once]
        each = np.arange(buckets + 1)
        ends, common_ends = (np.searchsorted(_bucket(g, buckets), each).tolist() for g in (grams[single], common))
        out = []
        for to in range(buckets):
            mine, ours = single[ends[to] : ends[to + 1]], slice(common_ends[to], common_ends[to + 1])
            if len(mine) or ours.stop > ours.start:
                out.append(_row(to, _bytes(doc[mine], np.uint16), _bytes(grams[mine], _U), _bytes(common[ours], _U), _bytes(counts[ours], np.uint32), kind="grams", size=chunk))
        sizes = np.array([len(s) for s in sets])
        whose = doc[np.repeat(~once, many)]
        out.append(_row(chunk % buckets, _bytes(np.array(names), np.int64), _bytes(sizes, np.int64), _bytes(common, _U), _bytes(counts, np.uint32), _bytes(whose, np.uint16), kind="names", size=chunk))
        return _table(out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        names: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, _, words in chunks(batch.column(0), lower=True):
                for _, grams in _sets(words, width):
                    name = _signature(grams)
                    if name in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    sets.append(grams)
                    held += len(grams)
                    if held >= full or len(names) == 1 << 16:
                        yield from rows(chunk, names, sets).to_batches()
                        chunk, names, sets, held = chunk + 1, [], [], 0
        if names:
            yield from rows(chunk, names, sets).to_batches()
        give_back()

    return docs.select("text").mapInArrow(emit, _BLOCK)


def _lengths(block: pa.Table, column: str, width: int) -> np.ndarray:
    return pc.binary_length(block.column(column)).to_numpy() // width


def _frequencies(block: pa.Table) -> pa.Table:
    """One bucket: ``shared`` rows by chunk of the n-grams that occur more than once
    (a: places in the chunk, b: n-grams, c: totals; d and e: n-grams that the chunk
    has more than once, and totals). Names pass through."""
    named = block.filter(pc.equal(block.column("kind"), "names"))
    block = block.filter(pc.equal(block.column("kind"), "grams"))
    chunk = block.column("size").to_numpy()
    grams = np.concatenate([_read(block, "b", _U), _read(block, "c", _U)])
    doc, counts = _read(block, "a", np.uint16), _read(block, "d", np.uint32)
    single = len(doc)
    place = np.arange(len(chunk), dtype=np.int32)
    row = np.concatenate([np.repeat(place, _lengths(block, "a", 2)), np.repeat(place, _lengths(block, "c", 8))])
    order = np.argsort(grams)
    sorted_grams = grams[order]
    first = np.flatnonzero(np.r_[True, sorted_grams[1:] != sorted_grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    del sorted_grams
    weight = np.concatenate([np.ones(single, np.int64), counts])[order]
    totals = np.minimum(np.add.reduceat(weight, first) if len(first) else weight, 2**32 - 1)
    many = np.empty(len(grams), np.uint32)
    many[order] = np.repeat(totals, np.diff(np.r_[first, len(grams)]))
    del order, weight, totals, first
    at = np.flatnonzero(many[:single] > 1)  # rows are still in order, first of the ones and then of the others
    mine, ours = ({r: part for r, part in _runs(x)} for x in (row[at], row[single:]))
    doc, own, own_many, more, more_many = doc[at], grams[at], many[at], grams[single:].copy(), many[single:].copy()
    del grams, many, row, at
    nothing = slice(0, 0)
    out = []
    for r in range(len(chunk)):
        m, o = mine.get(r, nothing), ours.get(r, nothing)
        if m.stop or o.stop:
            out.append(_row(int(chunk[r]), _bytes(doc[m], np.uint16), _bytes(own[m], _U), _bytes(own_many[m], np.uint32), _bytes(more[o], _U), _bytes(more_many[o], np.uint32), kind="shared"))
    give_back()
    named = pa.table({c: named.column("size" if c == "key" else c) for c in named.column_names}).cast(_table([]).schema)
    return pa.concat_tables([_table(out), named])


def _point(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Counts of each document's n-grams by group."""
    return np.bincount(doc * GROUPS + (grams >> _U(8)).astype(np.int64) % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS)


def _hot_links(names: np.ndarray, doc: np.ndarray, grams: np.ndarray) -> pa.Table:
    """(a, b): a chunk's sets with the hot n-grams they share, as few pairs as connect them.

    An n-gram is a node of its own, below all names."""
    nodes, of = np.unique(grams, return_inverse=True)
    union = Union(len(nodes) + len(names))
    for g, d in zip(of.tolist(), (doc + len(nodes)).tolist(), strict=True):
        union.join(g, d)
    every = np.unique(np.concatenate([of, doc + len(nodes)]))
    root = union.roots(every)
    label = -1 - (nodes >> _U(1)).astype(np.int64)
    to = np.concatenate([label, names])
    linked = every != root
    return pa.table({"a": pa.array(label[root[linked]], pa.int64()), "b": pa.array(to[every[linked]], pa.int64())})


def _cells(buckets: int, percent: int, hot: int):
    def choose(block: pa.Table) -> pa.Table:
        """One chunk: ``set`` rows of the sets that may have links (a: sorted n-grams
        that others have too), blocks of their cells (a: names, b: sizes, c: points,
        d: counts, e: n-grams) by bucket, and ``hot`` links (a and b, to be united)."""
        named = block.filter(pc.equal(block.column("kind"), "names"))
        block = block.filter(pc.equal(block.column("kind"), "shared"))
        names, size = _read(named, "a", np.int64), _read(named, "b", np.int64)
        n = len(names)
        common, counts = _read(named, "c", _U), _read(named, "d", np.uint32)
        told, totals = _read(block, "d", _U), _read(block, "e", np.uint32)
        order = np.argsort(told)
        told, totals = told[order], totals[order]
        of_common = totals[np.searchsorted(told, common)]  # each bucket answers for all of its own
        doc = np.concatenate([_read(block, "a", np.uint16), _read(named, "e", np.uint16)]).astype(np.int64)
        grams = np.concatenate([_read(block, "b", _U), np.repeat(common, counts)])
        many = np.concatenate([_read(block, "c", np.uint32), np.repeat(of_common, counts)])
        alone = size - np.bincount(doc, minlength=n)
        may_miss = size - -(-size * percent // 100)
        live = alone <= may_miss
        mine = live[doc]
        doc, grams, many = doc[mine], grams[mine], many[mine]
        order = np.lexsort((grams, many, doc))
        doc, grams, many = doc[order], grams[order], many[order]
        start = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - start[doc]
        prefix = rank < (may_miss + 1 - alone)[doc]
        points = _point(grams, doc, n)
        rows = []
        for k in np.flatnonzero(live).tolist():
            own = grams[start[k] : start[k + 1] if k + 1 < n else len(grams)]
            if len(own):
                rows.append(_row(int(names[k]), _bytes(np.sort(own), _U), kind="set", size=int(size[k])))
        warm = prefix & (many > hot)
        if warm.any():
            links = _hot_links(names, doc[warm], grams[warm])
            rows.append(_row(int(names[0]), _bytes(links.column("a").to_numpy(), np.int64), _bytes(links.column("b").to_numpy(), np.int64), kind="hot"))
        prefix &= ~warm
        doc, grams = doc[prefix], grams[prefix]
        bucket = _bucket(grams, buckets)
        order = np.lexsort((doc, bucket))
        grams = grams[order]
        for to, part, who, c in _cut(bucket[order], doc[order]):
            rows.append(_row(to, _bytes(names[who], np.int64), _bytes(size[who], np.int64), _bytes(points[who], np.uint32), _bytes(c, np.int32), _bytes(grams[part], _U), kind="cell"))
        give_back()
        return _table(rows)

    return choose


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of ``hot`` rows."""
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b)], names=["a", "b"])


# --- points -------------------------------------------------------------------


class CountRTree:
    """An R-tree, packed bottom up, over points of group counts.

    Points are sorted by set size, cut into slabs, and each slab sorted by its
    widest coordinate; every ``FAN`` neighbours share a node that knows their
    largest counts and smallest and largest sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        order = np.argsort(sizes, kind="stable")
        for s in range(0, len(order), FAN * FAN):
            slab = order[s : s + FAN * FAN]
            widest = int(np.ptp(points[slab], axis=0).argmax())
            order[s : s + FAN * FAN] = slab[np.argsort(points[slab, widest], kind="stable")]
        self.order = order
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FAN:
            p, low, high = self.levels[-1]
            at = np.arange(0, len(p), FAN)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose sets may link with a set of this point and size."""
        p = self.percent
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            points, low, high = (x[at] for x in self.levels[k])
            bound = np.minimum(points, point).sum(1)
            # overlap >= p/100 of the union, of which both sets are part
            ok = ((100 + p) * bound >= p * (size + low)) & (100 * bound >= p * size) & (100 * high >= p * size) & (100 * size >= p * low)
            at = at[ok]
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


class Union:
    """Disjoint sets of numbers; the smallest is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        up = self.parent[of]
        while (self.parent[up] != up).any():
            up = self.parent[up]
        self.parent[of] = up
        return up

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def unite(members: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int, union: Union, link) -> None:
    """Unites all ``members`` that ``link(x, y)`` connects, testing only pairs that the
    tree proposes and that are not connected yet."""
    roots = union.roots(members)
    if (roots == roots[0]).all():
        return
    if len(members) <= 2:
        x, y = int(members[0]), int(members[1])
        if 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]) and (100 + percent) * np.minimum(points[x], points[y]).sum() >= percent * (sizes[x] + sizes[y]) and link(x, y):
            union.join(x, y)
        return
    tree = CountRTree(points[members], sizes[members], percent)
    # the first's own group need not ask again: whoever is outside it asks for itself
    hub = None
    for x in members.tolist():
        if hub is not None and union.root(x) == union.root(hub):
            continue
        found = members[tree.near(points[x], int(sizes[x]))]
        for y in found.tolist():
            if union.root(x) != union.root(y) and link(x, y):
                union.join(x, y)
        if hub is None:
            hub = x


def _stars(names: np.ndarray, union: Union) -> pa.Table:
    """(a, b): every united name with the smallest of its group."""
    roots = union.roots(np.arange(len(names)))
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, names)
    a = least[roots]
    linked = a != names
    return pa.table({"a": pa.array(a[linked], pa.int64()), "b": pa.array(names[linked], pa.int64())})


def _candidates(percent: int):
    def propose(block: pa.Table) -> pa.Table:
        """One bucket of cells: stars of the sets that may link."""
        names, at, inverse = np.unique(_read(block, "a", np.int64), return_index=True, return_inverse=True)
        sizes, points = _read(block, "b", np.int64)[at], _read(block, "c", np.uint32).reshape(-1, GROUPS)[at].astype(np.int64)
        doc, grams = np.repeat(inverse, _read(block, "d", np.int32)), _read(block, "e", _U)
        order = np.lexsort((doc, grams))
        doc, grams = doc[order], grams[order]
        new = np.ones(len(doc), bool)  # equal sets may come from several tasks
        new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[new], grams[new]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        many = np.diff(np.r_[first, len(grams)])
        # cells with the same members need one look
        key = np.add.reduceat(stream(17, len(names))[doc], first) if len(doc) else np.zeros(0, _U)
        _, own = np.unique(key, return_index=True)
        own = own[many[own] > 1]
        union = Union(len(names))
        for k in own[np.argsort(many[own], kind="stable")].tolist():
            unite(doc[first[k] : first[k] + many[k]], points, sizes, percent, union, lambda x, y: True)
        return _stars(names, union)

    return propose


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Sets:
    """The sets of a task: n-grams, sizes, points, and the exact test."""

    def __init__(self, rows: pa.Table, percent: int):
        self.size, self.percent = rows.column("size").to_numpy(), percent
        self.grams = [np.frombuffer(x, _U) for x in rows.column("a").to_pylist()]
        n = len(self.grams)
        self.points = _point(np.concatenate(self.grams), np.repeat(np.arange(n), [len(s) for s in self.grams]), n) if n else np.zeros((0, GROUPS), np.int64)

    def link(self, x: int, y: int) -> bool:
        return self.alike(x, y, self.percent)

    def alike(self, x: int, y: int, percent: int) -> bool:
        return (100 + percent) * _overlap(self.grams[x], self.grams[y]) >= percent * int(self.size[x] + self.size[y])


def _verify(percent: int):
    def check(task: pa.Table) -> pa.Table:
        """Small blocks: stars of sets that do link."""
        names, blocks = task.column("node").to_numpy(), task.column("block").to_numpy()
        sets, union = _Sets(task, percent), Union(len(names))
        order = np.argsort(blocks, kind="stable")
        for _, part in _runs(blocks[order]):
            if part.stop - part.start > 1:
                unite(order[part], sets.points, sets.size, percent, union, sets.link)
        return _stars(names, union)

    return check


def _near_pivots(percent: int):
    def check(part: pa.Table, pivots: pa.Table) -> pa.Table:
        """A part of a large block: each set, the pivots that it links with as bits of
        ``mask``, in the order of their names, those that a set it links with may link
        with as bits of ``close``, and a pivot's own place among them."""
        pivots = pivots.sort_by("node")
        n = pivots.num_rows
        sets = _Sets(pa.concat_tables([t.select(["size", "a"]) for t in (pivots, part)], promote_options="default"), percent)
        further = max(0, 2 * percent - 100)  # 1 - Jaccard similarity is a metric
        masks, close = ([sum(1 << y for y in range(n) if sets.alike(k, y, p)) for k in range(n, n + part.num_rows)] for p in (percent, further))
        place = {x: k for k, x in enumerate(pivots.column("node").to_pylist())}
        own = [place.get(x) for x in part.column("node").to_pylist()]
        numbers = {k: pa.array(v, pa.int64()) for k, v in (("mask", masks), ("close", close), ("place", own))}
        return pa.table({"node": part.column("node"), "block": part.column("block")} | numbers)

    return check


def _sides(block: pa.Table) -> pa.Table:
    """The masks of a block, how many sets have each, and its pivots: the least pivot
    that each is connected with by way of masks (null for none), and whether its sets
    ask. Those without a pivot do, and those that are close to a pivot of another group
    unless theirs is the largest. Where two sets of different groups link, each is close
    to the other's pivot, so one of them asks."""
    masks, close, sets = (block.column(c).to_pylist() for c in ("mask", "close", "sets"))
    names = {p["place"]: p["node"] for own in block.column("pivots").to_pylist() for p in own}
    union = Union(len(names))
    bits = [[k for k in names if mask >> k & 1] for mask in masks]
    for own in bits:
        for k in own[1:]:
            union.join(own[0], k)
    roots = [union.root(own[0]) if own else None for own in bits]
    held = {r: sum(n for n, x in zip(sets, roots, strict=True) if x == r) for r in roots if r is not None}
    home = max(held, key=lambda r: (held[r], -r), default=None)
    asks = [r is None or (r != home and any(c >> k & 1 and union.root(k) != r for k in names)) for r, c in zip(roots, close, strict=True)]
    root = pa.array([None if r is None else names[r] for r in roots], pa.int64())
    return pa.table({c: block.column(c) for c in ("block", "mask", "close")} | {"root": root, "asks": pa.array(asks, pa.bool_())})


def _meet(percent: int):
    def check(task: pa.Table) -> pa.Table:
        """Sets that ask, and a part of their block: stars of groups with a set that asks."""
        names, at = np.unique(task.column("node").to_numpy(), return_index=True)
        asks = np.isin(names, task.filter(task.column("ask")).column("node").to_numpy())
        rows = task.take(pa.array(at))
        sets, union = _Sets(rows, percent), Union(len(names))
        root = pc.coalesce(rows.column("root"), rows.column("node")).to_numpy()
        _, first, of = np.unique(root, return_index=True, return_inverse=True)
        union.parent = first[of]
        tree = CountRTree(sets.points, sets.size, percent)
        for x in np.flatnonzero(asks).tolist():
            for y in tree.near(sets.points[x], int(sets.size[x])).tolist():
                if union.root(x) != union.root(y) and sets.link(x, y):
                    union.join(x, y)
        roots = union.roots(np.arange(len(names)))
        in_question = np.zeros(len(names), bool)
        in_question[roots[asks]] = True
        stars = _stars(names, union)
        keep = in_question[roots[np.searchsorted(names, stars.column("b").to_numpy())]]
        return stars.filter(pa.array(keep))

    return check


def _large_blocks(spark: SparkSession, large: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """(a, b): pairs that connect the linked sets of blocks (node, block, size, a, parts)
    that are too large for a task, and the tables they are in."""
    paths = [new_path(spark, name) for name in ("large", "near", "sides")]
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    held = write_table(large.withColumn("part", part), paths[0])
    row = F.struct("node", "size", "a")
    picked = held.groupBy("block", "parts").agg(F.array_distinct(F.array(*[F.min_by(row, F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)])).alias("pivots"))
    pivots = picked.select("block", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), "pivots").select("block", "part", F.inline("pivots"))
    near = held.groupBy("block", "part").cogroup(pivots.groupBy("block", "part")).applyInArrow(_near_pivots(percent), "node long, block long, mask long, close long, place long")
    near = write_table(near, paths[1])
    pivot = F.when(F.col("place").isNotNull(), F.struct("place", "node"))
    masks = near.groupBy("block", "mask", "close").agg(F.count(F.lit(1)).alias("sets"), F.collect_list(pivot).alias("pivots"))
    sides = write_table(masks.groupBy("block").applyInArrow(_sides, "block long, mask long, close long, root long, asks boolean"), paths[2])
    sided = near.join(sides, ["block", "mask", "close"]).select("node", "block", "root", "asks")
    linked = sided.where("root is not null").select(F.col("root").alias("a"), F.col("node").alias("b"))
    rooted = held.join(sided.drop("block"), "node")
    turns = F.ceil(F.greatest(F.count(F.lit(1)) / PART_SETS, F.sum("size") * 8 / PART_BYTES))
    many = held.select("node", "block", "size").join(sided.where("asks").select("node"), "node").groupBy("block").agg(turns.alias("turns"))
    rows = rooted.join(many, "block").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(0)), F.col("turns")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    place = lambda i, j, ask: F.struct(i.alias("i"), j.alias("j"), F.lit(ask).alias("ask"))
    answers = F.transform(every(F.col("turns")), lambda i: place(i, F.col("part"), False))
    asks = F.when(F.col("asks"), F.transform(every(F.col("parts")), lambda j: place(F.col("turn"), j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,ask:boolean>>"))
    met = rows.select("node", "block", "size", "a", "root", F.inline(F.concat(answers, asks)))
    return linked.union(met.groupBy("block", "i", "j").applyInArrow(_meet(percent), "a long, b long")), paths


def links(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(node, label) of the set names that link with another set."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, size // GRAM_BYTES // BUCKET_GRAMS)
    # each step is written and its shuffle let go before the next one shuffles
    shared, path = new_path(spark, "shared"), new_path(spark, "cells")
    _deal(docs, width, buckets).groupBy("key").applyInArrow(_frequencies, _BLOCK).write.parquet(shared)
    release(spark)
    spark.read.schema(_BLOCK).parquet(shared).groupBy("key").applyInArrow(_cells(buckets, percent, HOT_CELL), _BLOCK).write.partitionBy("kind").parquet(path)
    drop_table(spark, shared)
    release(spark)
    stored = spark.read.schema(_BLOCK).parquet(path)
    stars = stored.where("kind = 'cell'").groupBy("key").applyInArrow(_candidates(percent), "a long, b long")
    blocks = components(stars.union(stored.where("kind = 'hot'").select("a", "b").mapInArrow(_unpack, "a long, b long"))).withColumnRenamed("label", "block")
    sets = stored.where("kind = 'set'").select(F.col("key").alias("node"), "size", "a").dropDuplicates(["node"])
    weighed = blocks.join(sets.select("node", "size"), "node").groupBy("block").agg(F.count(F.lit(1)).alias("sets"), (F.sum("size") * 8).alias("bytes"))
    sizes = new_path(spark, "blocks")
    weighed = write_table(weighed.withColumn("parts", F.ceil(F.greatest(F.col("sets") / PART_SETS, F.col("bytes") / PART_BYTES))), sizes)
    total = weighed.where("parts = 1").agg(F.sum("sets").alias("sets"), F.sum("bytes").alias("bytes")).first()
    bins = 1 + max((total["sets"] or 0) // BIN_SETS, (total["bytes"] or 0) // PART_BYTES)
    placed = blocks.join(weighed.select("block", "parts"), "block").join(sets, "node")
    small = placed.where("parts = 1").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins))).drop("parts")
    stars = write_table(small.groupBy("bin").applyInArrow(_verify(percent), "a long, b long"), new_path(spark, "links"))
    if weighed.where("parts > 1").isEmpty():  # no block was cut, so the stars are the components
        out = stars.select(F.col("b").alias("node"), F.col("a").alias("label")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    else:
        found, paths = _large_blocks(spark, placed.where("parts > 1"), percent)
        out = components(stars.union(found))
        for p in paths:
            drop_table(spark, p)
    drop_table(spark, sizes)
    drop_table(spark, path)
    release(spark)
    return out


def members(docs: DataFrame, width: int = 5, percent: int = 75, carry: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, n_shingles, label, *carry) of every row, written: the size of its set
    and its component's name, which is null where there are no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    named = links(rows, width, percent)
    mine = signatures(rows, width).join(named.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    return write_table(mine.select("doc_id", "n_shingles", "label", *rows.columns[2:]), new_path(docs.sparkSession, "members"))


def join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the
    smallest doc_id that links reach from it, its own included."""
    mine = members(docs, width, percent)
    # written, so that the join below reads both sides from shuffles that can be split:
    # a component may hold a large part of all rows
    least = mine.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    least = write_table(least, new_path(docs.sparkSession, "components"))
    return mine.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
