"""Byte-level byte-pair encoding: pre-tokens, heap merges, cached ids.

The pre-tokeniser is the published pattern of byte-level vocabularies
(contractions, letters, numbers, other, white space). For texts whose code
points are all below U+0530 it is compiled for the standard ``re`` engine from
Unicode categories; any other text is split by the library itself, since
Unicode versions differ above. Special tokens inside texts are one token each.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: First code point that the compiled pattern does not cover, and its first UTF-8 byte.
LIMIT, LIMIT_BYTE = 0x530, 0xD4
#: Pre-tokens that a worker remembers, those of them that it never forgets, and the
#: characters of the longest that it remembers: together they bound a cache's bytes.
CACHE_ENTRIES, CACHE_CORE, CACHE_CHARS = 450_000, 150_000, 64

_HIGH = re.compile(f"[\\u{LIMIT:04x}-\\U0010ffff]")


def _ranges(test: Callable[[str], bool]) -> str:
    runs: list[list[int]] = []
    for cp in range(LIMIT):
        if test(chr(cp)):
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


@lru_cache(1)
def low_pattern() -> re.Pattern:
    """The pre-token pattern for texts below ``LIMIT``."""
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = _ranges(lambda c: c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"))
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict(zip(plain, map(chr, plain), strict=True))
    extra = iter(range(0x100, 0x200))
    return [shown[b] if b in shown else chr(next(extra)) for b in range(256)]


def heap_merge_count(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after all merges: the initial number less one for each merge.

    A heap holds (rank, place) of adjacent pairs, links give each place's living
    neighbours; the lowest rank, then the leftmost place, merges first. Entries
    whose pair has changed meanwhile are skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    get, left = pairs.get, n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = (symbols[i], symbols[i + 1])
        if (found := get(pair)) is not None:
            heap.append((found[0], i, pair, found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, pair, merged = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = merged, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := get(pair := (merged, symbols[k]))) is not None:
                heapq.heappush(heap, (found[0], i, pair, found[1]))
        h = before[i]
        if h >= 0 and (found := get(pair := (symbols[h], merged))) is not None:
            heapq.heappush(heap, (found[0], h, pair, found[1]))
    return left


class Remembered(dict):
    """Results of ``make`` by word. Once ``entries`` are held, all but the first
    ``CACHE_CORE`` go: frequent words come early. Words of more than ``CACHE_CHARS``
    characters are made anew each time."""

    def __init__(self, make: Callable[[str], object], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, word: str):
        if len(word) > CACHE_CHARS:
            return self.make(word)
        if len(self) >= self.entries:
            self.shrink()
        made = self[word] = self.make(word)
        return made

    def shrink(self) -> None:
        """Keeps the core. Workers outlive tasks, so a task ends with this."""
        if len(self) > CACHE_CORE:
            core = list(islice(self.items(), CACHE_CORE))
            self.clear()
            self.update(core)


class ByteBpe:
    """A byte-level vocabulary file, with the caches of one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.first = [vocab[s] for s in byte_symbols()]
        self._symbols = dict(enumerate(byte_symbols()))
        self.counts: dict[str, int] = Remembered(self._count)
        self.ids: dict[str, bytes] = Remembered(self._ids)
        self._split = low_pattern().findall

    def segments(self, text: str) -> Iterable[tuple[str, int | None]]:
        """Runs of ordinary text, and special tokens with their id."""
        if self._special is None:
            return [(text, None)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def pretokens(self, text: str, low: bool = False) -> list[str]:
        """``low``: the caller knows that all code points are below ``LIMIT``."""
        if low or not _HIGH.search(text):
            return self._split(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def parts(self, text: str, low: bool = False) -> list[tuple[list[str], int | None]]:
        if self._special is None or not self._special.search(text):
            return [(self.pretokens(text, low), None)]
        return [([], i) if i is not None else (self.pretokens(s, low), None) for s, i in self.segments(text)]

    def count(self, text: str, low: bool = False) -> int:
        """Tokens of ``text``, by heap merges of each distinct pre-token."""
        total = 0
        for words, special in self.parts(text, low):
            total += 1 if special is not None else sum(map(self.counts.__getitem__, words))
        return total

    def encode(self, text: str, low: bool = False) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit numbers, from the library."""
        out = []
        for words, special in self.parts(text, low):
            out.append(special.to_bytes(4, "little") if special is not None else b"".join(map(self.ids.__getitem__, words)))
        return b"".join(out)

    def _count(self, word: str) -> int:
        first = self.first
        return heap_merge_count([first[b] for b in word.encode()], self.pairs)

    def _ids(self, word: str) -> bytes:
        tokens = self.library.model.tokenize(word.encode().decode("latin-1").translate(self._symbols))
        return array("I", [t.id for t in tokens]).tobytes()


@lru_cache(2)
def load(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)


def is_low(texts) -> bool:
    """Whether an Arrow string array has code points below ``LIMIT`` only."""
    import numpy as np

    data = texts.buffers()[-1]
    return data is None or not len(data) or int(np.frombuffer(data, np.uint8).max()) < LIMIT_BYTE
