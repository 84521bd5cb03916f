"""Whole Arrow batches of text turned into numpy word hashes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; since those are
ASCII, cutting UTF-8 bytes gives the same words as cutting code points. A word's
hash is a 64-bit multilinear hash of its bytes with position-dependent odd
weights, finished by a mixing step. Everything is vectorised over a chunk of
texts, so the cost is a few nanoseconds a byte and there is no per-word Python.

Null texts count as empty. No text is ever cut: a chunk always holds whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds unless a single text is longer.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)  # glibc has it
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of a fixed pseudo-random sequence."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_weights = stream(2, 1 << 12) | _U(1)


def _weight_table(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = stream(2, 1 << int(n - 1).bit_length()) | _U(1)
    return _weights


class Words:
    """Words of a chunk of texts.

    ``hash``: one per word; ``first``: index of each text's first word, with one
    more entry for the end; ``start``/``end``: byte offsets in ``data``;
    ``original``: the bytes before lower-casing.
    """

    __slots__ = ("data", "end", "first", "hash", "original", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.original = data
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        before[cuts] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, _U)
        lengths = self.end - self.start
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(at[-1] + lengths[-1]), dtype=np.int64)
        place -= np.repeat(at, lengths)
        terms = _BYTE[self.data[inside]]
        terms *= _weight_table(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, at) + lengths.astype(_U))


def ngram_hashes(words: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hashes of all ``n`` consecutive entries of ``words`` (texts not told apart)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    by = stream(seed, n) | _U(1)
    out = words[:m] * by[0]
    for k in range(1, n):
        out += words[k : k + m] * by[k]
    return mix(out)


def blob_values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All numbers in a binary column, one after the other, without a copy where it is one chunk."""
    blobs = column.combine_chunks()
    if isinstance(blobs, pa.ChunkedArray):
        blobs = pa.concat_arrays(blobs.chunks) if blobs.num_chunks else pa.array([], column.type)
    _, offsets, data = blobs.buffers()
    if not len(blobs) or data is None:
        return np.zeros(0, kind)
    wide = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind)


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, count=texts.offset + n + 1)[texts.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Yields (first row, row after the last, Words) for runs of rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = _bytes_of(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(n, max(i + 1, j))
        own = offsets[i : j + 1]
        yield i, j, Words(data[own[0] : own[-1]], own - own[0], lower)
        i = j
