"""Token counts by heap-and-linked-list byte-pair merging.

``token_counts`` counts the tokens of whole texts without making ids: a text is
split into pre-tokens, each distinct pre-token's symbols are merged by a heap of
adjacent pairs, and its count is the number of initial symbols less merges.
Workers remember counts of pre-tokens in a cache of bounded size. A text is one
row of one task: no shuffle, nothing is collected.

Cases: a null text counts as empty (0 bytes, 0 tokens); a null id stays null;
rows that repeat give rows that repeat; an empty table gives an empty table;
other columns of the input are ignored, whatever their names. Special strings
inside a text are one token, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import is_low, load
from .store import small_batches, type_of
from .textnum import give_back


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``vocabulary``: path, on every executor, of a byte-level BPE file of the
    tokenizers library; ``over_limit``: whether there are more than ``limit`` tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            low = is_low(texts)
            tokens = [bpe.count(t, low) for t in texts.to_pylist()]
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {type_of(rows, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean")
