"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.bpe import SPECIAL, Splitter, Store, Vocabulary, merged_ragged, texts_to_ids
from foliate.llm.common import in_arrow, slices, text_of, utf8

_STORES: dict[str, tuple[Splitter, Store]] = {}


def _counter(path: str) -> tuple[Splitter, Store]:
    if path not in _STORES:
        vocabulary = Vocabulary.of_json(path)
        _STORES[path] = Splitter(public_tokenizers.PATTERN), Store(lambda new: merged_ragged(vocabulary, [x.encode() for x in new]))
    return _STORES[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Gives (id, n_bytes, n_tokens, over_limit) for each of its rows, without a shuffle.

    vocabulary: the path of a byte-level BPE file of the tokenizers library. Tokens are counted as that
    library counts them by default: the special string inside a text is one token, no tokens are added.
    Null text counts as empty: 0 bytes, 0 tokens. Rows with null or repeated ids are kept as they are; other
    columns are not read. Long texts are worked on whole, a few megabytes of text at a time.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, store = _counter(path)
        for batch in batches:
            text = batch.column(1)
            _, offsets = utf8(text)
            n = np.zeros(len(text), np.int64)
            for a, b in slices(offsets, 1 << 21):
                n[a:b] = texts_to_ids(text[a:b].to_pylist(), split, store, (SPECIAL, -1), wanted=False)[1]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = in_arrow(rows, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
