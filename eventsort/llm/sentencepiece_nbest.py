"""SentencePiece N-best encoding, and decoding.

A text's pieces form a lattice. Forward Viterbi gives, for every place, the best
score of any path from the start; these are exact heuristics for an A* search
that walks back from the end, so the first N paths that reach the start are the
N best. Scores are the model's own piece scores, summed; a character that no
piece covers costs the least score less ``UNKNOWN_PENALTY`` and is written as its
bytes' pieces. (The library gives N-best lists for unigram models only; the
lattice here takes any model's pieces and scores as such.)

No piece spans two characters that stand side by side in none, so a text falls
into *units* that can be solved alone: the best path is the units' best paths,
and the N best come from the N - 1 units with the smallest losses. Units repeat,
so each worker remembers solved units, a bounded number of bounded length: of most
only the best path and the loss of the second, of those N - 1 all N paths.

Cases: a null text counts as empty, has one path without pieces and of score 0;
a text with fewer than N segmentations has as many paths as there are;
null ids and repeated rows stay; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import CACHE_CHARS, Remembered
from .store import small_batches, type_of
from .textnum import give_back

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Units that a worker remembers.
CACHE_UNITS = 1_200_000
#: Units whose N best paths a worker remembers.
CACHE_TOPS = 50_000

Path = tuple[float, tuple[int, ...]]


class PieceModel:
    """Pieces of a SentencePiece file."""

    def __init__(self, path: str, n_best: int = 2):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        kinds = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(self.pieces))]
        self.ids = {p: i for i, (p, (byte, other)) in enumerate(zip(self.pieces, kinds, strict=True)) if not byte and not other}
        self.scores = [float(model.get_score(i)) for i in range(len(self.pieces))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, (byte, _) in enumerate(kinds) if byte}
        self.unknown = model.unk_id()
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.adjacent = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # by character: (the same for what follows, id and score of the piece that ends here; id -1 for none)
        self.trie: dict[str, tuple] = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, ({}, -1, 0.0))[0]
            node[p[-1]] = (node.get(p[-1], ({},))[0], i, self.scores[i])
        self.surface = [bytes([int(p[3:5], 16)]) if byte else b"" if other else p.replace(SPACE, " ").encode() for p, (byte, other) in zip(self.pieces, kinds, strict=True)]
        self.rough = self._rough()
        self.solved: dict[str, tuple] = Remembered(self._solve, CACHE_UNITS)
        self.tops: dict[str, Sequence[tuple[float, bytes]]] = {}

    def _rough(self) -> re.Pattern:
        """Cuts texts where no piece goes across: before spaces, and between letters and others."""
        odd = "".join(sorted({c for p in self.adjacent for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[\d_{odd}]|[^\w{SPACE}])"
        is_letter = re.compile(letter).match
        if any(b == SPACE != a or (a != SPACE and bool(is_letter(a)) != bool(is_letter(b))) for a, b in self.adjacent):
            return re.compile(r"[\s\S]+")
        return re.compile(f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+")

    # --- one lattice ---

    def _forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """By place: the best score from the start, and the pieces (start, id, score) that end there."""
        size, trie, known = len(unit), self.trie, self.ids
        best: list[float] = [0.0] + [-inf] * size
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            here, node = best[i], trie
            for j in range(i, size):
                found = node.get(unit[j])
                if found is None:
                    break
                node, piece, score = found
                if piece >= 0:
                    into[j + 1].append((i, piece, score))
                    score += here
                    if score > best[j + 1]:
                        best[j + 1] = score
                if not node:
                    break
            if unit[i] not in known:
                into[i + 1].append((i, -1, self.unknown_score))
                best[i + 1] = max(best[i + 1], here + self.unknown_score)
        return best, into

    def second(self, unit: str) -> tuple[list[int], float, float]:
        """(ids, score, loss of the second best) of the lattice's best path. The search for
        two paths follows one back, and the best hypothesis it leaves open is the other."""
        best, into = self._forward(unit)
        at, ids, least = len(unit), [], inf
        while at:
            top = other = -inf
            for start, piece, score in into[at]:
                score += best[start]
                if score > top:
                    other, top, before, chosen = top, score, start, piece
                elif score > other:
                    other = score
            if top - other < least:
                least = top - other
            if chosen >= 0:
                ids.append(chosen)
            else:
                ids += self._as_bytes(unit[before:at])[::-1]
            at = before
        return ids[::-1], best[-1], least

    def paths(self, unit: str, n: int) -> list[Path]:
        """The ``n`` best (score, ids) of the lattice over ``unit``, best first.

        Every hypothesis of the search is the tail of a path with exactly its
        estimate, so no more than the ``n`` best hypotheses need be kept."""
        size = len(unit)
        best, into = self._forward(unit)
        out: list[Path] = []
        # (estimate, -order, place, score of the tail, tail), best last
        open_: list[tuple[float, int, int, float, tuple | None]] = [(best[size], 0, size, 0.0, None)]
        order, room, least = 0, n, -inf  # ``least``: what an estimate must exceed, once ``room`` are open
        while open_ and room:
            _, _, at, done, tail = open_.pop()
            if not at:
                ids: list[int] = []
                while tail is not None:
                    start, end, piece, tail = tail
                    ids += (piece,) if piece >= 0 else self._as_bytes(unit[start:end])
                out.append((done, tuple(ids)))
                room -= 1
            else:
                least = open_[0][0] if len(open_) >= room else -inf
                for start, piece, score in into[at]:
                    score += done
                    estimate = best[start] + score
                    if estimate > least:
                        order -= 1
                        insort(open_, (estimate, order, start, score, (start, at, piece, tail)))
                        if len(open_) > room:
                            del open_[0]
                        if len(open_) == room:
                            least = open_[0][0]
        return out

    def _as_bytes(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unknown]

    # --- texts ---

    def _part(self, part: str, n: int) -> tuple:
        return tuple((s, array("I", ids).tobytes()) for s, ids in self.paths(part, n))

    def _cuts(self, unit: str) -> list[int]:
        return [0, *[k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.adjacent], len(unit)]

    def _solve(self, unit: str) -> tuple:
        """(ids of the best path, its score, the second's loss) of a rough unit."""
        cuts = self._cuts(unit)
        found = [self.second(unit[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        loss = min(x[2] for x in found)
        if loss < 1e-6:  # of equal paths, the one that the search for n finds first
            tops = self._tops(unit, 2)
            return tops[0][1], tops[0][0], 0.0
        return array("I", [i for x in found for i in x[0]]).tobytes(), sum([x[1] for x in found]), loss

    def _tops(self, unit: str, n: int) -> Sequence[tuple[float, bytes]]:
        cuts = self._cuts(unit)
        if len(cuts) == 2:
            return self._part(unit, n)
        return combine([self._part(unit[a:b], n) for a, b in zip(cuts, cuts[1:], strict=False)], n)

    def _remembered_tops(self, unit: str) -> Sequence[tuple[float, bytes]]:
        found = self.tops.get(unit)
        if found is None:
            found = self._tops(unit, self.n_best)
            if len(unit) <= CACHE_CHARS:
                if len(self.tops) >= CACHE_TOPS:
                    self.tops.clear()
                self.tops[unit] = found
        return found

    @staticmethod
    def normalise(text: str) -> str:
        """The identity rule with a space before the text: spaces are written as pieces write them."""
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def solve(self, text: str) -> list[tuple[float, bytes]]:
        """The ``n_best`` best (score, ids) of a text, best first."""
        if not text:
            return [(0.0, b"")]
        units = self.rough.findall(self.normalise(text))
        ids, scores, losses = zip(*map(self.solved.__getitem__, units), strict=True)
        best = sum(scores)
        few = [k for k in heapq.nsmallest(self.n_best - 1, range(len(units)), key=losses.__getitem__) if losses[k] < inf]
        out = [(best, b"".join(ids))]
        for loss, which in options({k: self._remembered_tops(units[k]) for k in few}, self.n_best)[1:]:
            parts = list(ids)
            for k, j in which.items():
                if j:
                    parts[k] = self._remembered_tops(units[k])[j][1]
            out.append((best - loss, b"".join(parts)))
        return out

    def n_best_of(self, text: str) -> list[tuple[float, list[int]]]:
        """The same, with lists of ids."""
        return [(s, list(array("I", ids))) for s, ids in self.solve(text)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text that pieces stand for, without the space put before it."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def options(lists: dict[int, Sequence[tuple[float, bytes]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` least (loss, which entry of each list), the first of no loss; entries are best first."""
    out: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for k, entries in lists.items():
        top = entries[0][0]
        out = heapq.nsmallest(n, [(loss + top - s, {**which, k: j}) for loss, which in out for j, (s, _) in enumerate(entries)], key=lambda o: o[0])
    return out


def combine(lists: Sequence[Sequence[tuple[float, bytes]]], n: int) -> list[tuple[float, bytes]]:
    """The ``n`` best sums of one entry from each list; entries are best first.

    Only lists whose second entry loses least can differ from their first."""
    few = sorted((k for k, x in enumerate(lists) if len(x) > 1), key=lambda k: lists[k][0][0] - lists[k][1][0])[: n - 1]
    base = sum([x[0][0] for x in lists])
    return [(base - loss, b"".join([x[which.get(k, 0)][1] for k, x in enumerate(lists)])) for loss, which in options({k: lists[k] for k in few}, n)]


@lru_cache(2)
def load(path: str, n_best: int) -> PieceModel:
    return PieceModel(path, n_best)


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True, n_best: int = 5) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, score, second_score, round_trip, n_best[, ids]) of every row.

    ``score``, ``second_score``: of the best and the next best segmentation (null if
    there is one only); ``round_trip``: whether decoding gives the text back;
    ``n_best``: (rank, n_pieces, ids_crc32, score[, ids]) of the ``n_best`` best
    segmentations, best first; ``ids``: little-endian unsigned 32-bit numbers."""
    if n_best < 2:
        raise ValueError("n_best must be 2 at least, for second_score")
    fields = {"rank": pa.int32(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "score": pa.float64()} | ({"ids": pa.binary()} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, n_best)
        for batch in batches:
            second, same, starts = [], [], [0]
            paths: list[tuple] = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = model.solve(text)
                paths += [(k, len(ids) // 4, zlib.crc32(ids), score, ids)[: len(fields)] for k, (score, ids) in enumerate(found, 1)]
                starts.append(len(paths))
                second.append(found[1][0] if len(found) > 1 else None)
                same.append(model.decode(memoryview(found[0][1]).cast("I")) == text)
            columns = list(zip(*paths, strict=True)) if paths else [[] for _ in fields]
            flat = {name: pa.array(c, t) for (name, t), c in zip(fields.items(), columns, strict=True)}
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(list(flat.values()), names=list(flat)))
            best = {name: c.take(pa.array(starts[:-1], pa.int32())) for name, c in flat.items()}
            arrays = [batch.column(0), best["n_pieces"], best["ids_crc32"], best["score"], pa.array(second, pa.float64()), pa.array(same, pa.bool_()), lists]
            yield pa.RecordBatch.from_arrays(arrays + ([best["ids"]] if keep_ids else []), names=["doc_id", "n_pieces", "ids_crc32", "score", "second_score", "round_trip", "n_best"] + ["ids"] * keep_ids)
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    path = "rank: int, n_pieces: long, ids_crc32: long, score: double" + ", ids: binary" * keep_ids
    return rows.mapInArrow(run, f"doc_id {type_of(rows, 'doc_id')}, n_pieces long, ids_crc32 long, score double, second_score double, round_trip boolean, n_best array<struct<{path}>>" + ", ids binary" * keep_ids)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, 2)
        for batch in batches:
            texts = [None if ids is None else model.decode(memoryview(ids).cast("I")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {type_of(rows, 'doc_id')}, text string")
