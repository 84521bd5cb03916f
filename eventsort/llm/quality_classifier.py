"""Quality classifier: random indexing, pooling, a two-layer network, calibration.

Fitting, on the driver, over at most ``fit_rows`` labelled texts of together at most
``fit_bytes`` bytes:

* every frequent word gets a sparse random index vector made from its hash; its
  word vector is the sum of the index vectors of the words next to it;
* every word also has a *shape* (symbols, capitals, digits, length, whether it
  repeats the word before), whose index vector is random too;
* a document is the mean of its words' vectors beside the mean of its shapes';
* a network with one hidden layer is trained by Adam; rows held back say when to
  stop, and choose the temperature that calibrates its probabilities.

Scoring is one pass over whole texts, chunk by chunk in numpy; the model, of
bounded size, travels with the task. Only texts are inputs of a score.

Cases: null and empty texts have the mean of nothing, the zero vector, and get
its score; without both labels the score is the share of good labels (0.5 if
there is none); null ids are scored, not learnt from, and not held out; repeated
rows are scored each; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, type_of
from .textnum import Words, chunks, stream

#: Labelled texts that are learnt from at most, and their bytes; words with a vector.
FIT_ROWS, FIT_BYTES, VOCABULARY = 5_000, 64 << 20, 20_000
WORD_DIMS, SHAPE_DIMS, SHAPES, HIDDEN = 32, 48, 256, 24
EPOCHS, RATE, DECAY = 400, 0.02, 1e-4

_FIELDS = (b"#*$%&|<>~^=", b"!?", bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256)), b"0123456789")
#: Bits of a field of counts, five of which are added up as one number.
FIELD_BITS = 12
_PACKED = np.zeros(256, np.uint64)
for _k, _bytes in enumerate(_FIELDS):
    _PACKED[list(_bytes)] = np.uint64(1 << (FIELD_BITS * _k))


def shapes(words: Words, original: np.ndarray) -> np.ndarray:
    """One of ``SHAPES`` numbers for each word; ``original``: the bytes before lower-casing."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    length = words.end - words.start
    at = np.cumsum(length) - length
    inside = np.repeat(words.start - at, length) + np.arange(int(length.sum()))
    packed = np.add.reduceat(_PACKED[original[inside]], at)
    counts = np.stack([(packed >> np.uint64(FIELD_BITS * k)) & np.uint64((1 << FIELD_BITS) - 1) for k in range(len(_FIELDS))])
    for k in np.flatnonzero(length >> FIELD_BITS).tolist():  # fields of longer words would run over
        seen = np.bincount(original[words.start[k] : words.end[k]], minlength=256)
        counts[:, k] = [seen[list(field)].sum() for field in _FIELDS]
    symbol, shout, upper, lower, digit = counts
    again = np.zeros(n, bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][words.first[:-1] < n]] = False  # what stands before is another text
    bits = (symbol > 0, shout > 0, (upper > 1) & (lower == 0), digit > 0, upper + lower + digit == 0, again, length > 4, length > 12)
    return sum(b.astype(np.int64) << k for k, b in enumerate(bits))


def index_vectors(seeds: np.ndarray, dims: int) -> np.ndarray:
    """Sparse ternary vectors, four entries each, fixed by 64-bit ``seeds``."""
    out = np.zeros((len(seeds), dims), np.float32)
    rows = np.arange(len(seeds))
    for k in range(4):
        part = (seeds >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out[rows, (part >> np.uint64(1)) % np.uint64(dims)] += np.where(part & np.uint64(1), 1, -1)
    return out


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray  # a row for each, and a last row of zeros
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None = None

    def pooled(self, words: Words, original: np.ndarray) -> np.ndarray:
        """A row for each text: mean word vector, mean shape vector."""
        n = len(words.first) - 1
        counts = np.maximum(np.diff(words.first), 1)[:, None]
        text = np.repeat(np.arange(n), np.diff(words.first))
        shape = np.bincount(text * SHAPES + shapes(words, original), minlength=n * SHAPES).reshape(n, SHAPES)
        at = np.minimum(np.searchsorted(self.words, words.hash), max(0, len(self.words) - 1))
        known = self.words[at] == words.hash if len(self.words) else np.zeros(len(at), bool)
        rows = self.vectors[np.where(known, at, len(self.words))]
        means = np.zeros((n, WORD_DIMS), np.float32)
        full = np.flatnonzero(np.diff(words.first))
        if len(full):
            means[full] = np.add.reduceat(rows, words.first[full], axis=0)
        return np.hstack([means / counts, (shape / counts) @ _SHAPE_VECTORS])

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return _sigmoid(_logits((pooled - self.mean) / self.scale, self.layers) / self.temperature)


_SHAPE_VECTORS = index_vectors(stream(11, SHAPES), SHAPE_DIMS) / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _logits(x: np.ndarray, layers: Sequence[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2[0]


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def _train(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weights of the step whose loss on the rows held back was least; of the last without such rows."""
    best: tuple[float, tuple[np.ndarray, ...]] = (np.inf, ())
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ layers[0] + layers[1])
        miss = (_sigmoid(hidden @ layers[2] + layers[3][0]) - y) / len(y)
        back = np.outer(miss, layers[2]) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * layers[0], back.sum(0), hidden.T @ miss + DECAY * layers[2], np.array([miss.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(held_y) and step % 5 == 0 and (loss := _loss(_logits(held_x, layers), held_y)) < best[0]:
            best = (loss, tuple(layers))
    return best[1] or tuple(layers)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    return float(min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(logits / t, y)))


def fit_texts(texts: Sequence[str | None], good: Sequence[int]) -> Model:
    """Fits a model to texts marked 1 (good) or 0."""
    y = np.asarray(good, float)
    empty = Model(np.zeros(0, np.uint64), np.zeros((1, WORD_DIMS), np.float32), np.zeros(WORD_DIMS + SHAPE_DIMS), np.ones(WORD_DIMS + SHAPE_DIMS), (), 1.0)
    if len(set(y.tolist())) < 2:
        empty.constant = float(y.mean()) if len(y) else 0.5
        return empty
    parts = [(w, o) for w, o in _chunks(pa.array(texts, pa.large_string()))]
    hashes, counts = np.unique(np.concatenate([w.hash for w, _ in parts]), return_counts=True)
    vocabulary = np.sort(hashes[np.argsort(-counts, kind="stable")[:VOCABULARY]])
    index = np.vstack([index_vectors(vocabulary, WORD_DIMS), np.zeros((1, WORD_DIMS), np.float32)])
    vectors = np.zeros_like(index)
    for words, _ in parts:
        at = np.searchsorted(vocabulary, words.hash)
        at[at == len(vocabulary)] = 0
        ids = np.where(vocabulary[at] == words.hash, at, len(vocabulary))
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        for k in (1, 2):
            same = np.flatnonzero(text[:-k] == text[k:])
            np.add.at(vectors, ids[same], index[ids[same + k]])
            np.add.at(vectors, ids[same + k], index[ids[same]])
    vectors[-1] = 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    model = empty
    model.words, model.vectors = vocabulary, vectors
    x = np.vstack([model.pooled(w, o) for w, o in parts])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.mean) / model.scale
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    model.layers = _train(x[~held], y[~held], x[held], y[held])
    model.temperature = _temperature(_logits(x[held], model.layers), y[held]) if held.any() else 1.0
    return model


def _chunks(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    for _, _, words in chunks(texts, lower=True):
        yield words, words.original


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learns from at most ``fit_rows`` rows that are not held out, chosen by hash, and
    of these from the first that have ``fit_bytes`` bytes of text together.

    ``labels``: doc_id, quality. Their ids are bounded and broadcast, so no text is
    shuffled to find the sample."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("classifier"))
    chosen = labels.select("doc_id", "quality").dropna().where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(fit_rows)
    place = F.struct(order.alias("order"), "doc_id", F.xxhash64("text").alias("hash")).alias("place")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(place, "text", "quality")
    sizes = rows.select("place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy("place").limit(fit_rows).collect()
    total = np.cumsum([r["bytes"] for r in sizes])
    some = sizes[: int(np.searchsorted(total, fit_bytes, "right"))]
    if some:
        last = some[-1]["place"]
        till = F.struct(F.lit(last["order"]).alias("order"), F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["hash"]).alias("hash"))
        found = rows.where(F.col("place") <= till).orderBy("place").limit(len(some)).collect()
    else:
        found = []
    return fit_texts([r["text"] for r in found], [r["quality"] for r in found])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.pooled(w, o)) for w, o in _chunks(batch.column(2))]
            scores = np.clip(np.concatenate(scores) if scores else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, score double, predicted int")
