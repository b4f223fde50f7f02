"""Byte-level BPE encoding and decoding by length-bucketed padded matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.bpe import Splitter, Store, Vocabulary, merged_padded, texts_to_ids
from foliate.llm.common import in_arrow, ragged, slices, text_of, utf8

_CODECS: dict[str, Codec] = {}


class Codec:
    """Encodes texts to ids and ids to bytes with one file of ranks."""

    def __init__(self, path: str):
        vocabulary = Vocabulary.of_ranks(path)
        self.split = Splitter(public_tokenizers.PATTERN)
        self.store = Store(lambda new: merged_padded(vocabulary, [x.encode() for x in new]))
        self.bytes_table = _table(vocabulary.bytes_of)
        self.decimal_table = _table([b"%d," % i for i in range(len(vocabulary.bytes_of))])

    @staticmethod
    def of(path: str) -> Codec:
        if path not in _CODECS:
            _CODECS[path] = Codec(path)
        return _CODECS[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each)."""
        return texts_to_ids(texts, self.split, self.store, None)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The bytes of each text."""
        return _looked_up(self.bytes_table, ids, counts)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The ids of each text as decimals, joined by commas."""
        return [x[:-1] for x in _looked_up(self.decimal_table, ids, counts)]


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths


def _looked_up(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
    data, starts, lengths = table
    each = lengths[ids]
    out = memoryview(data[ragged(starts[ids], each)])
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row: the ids of the whole text, without special tokens, in text order.

    Null text has no ids. Decode with decoded(). No shuffle; ids and other columns as in df.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(utf8(text)[1], 1 << 21):
                ids, counts = codec.encode(text[a:b].to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = in_arrow(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), encode, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id, data binary): the bytes that the ids stand for; null ids give empty bytes."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.column(1)[k : k + 512]
                counts = np.diff(np.asarray(part.offsets))
                yield pa.record_batch([batch.column(0)[k : k + 512], pa.array([bytes(x) for x in codec.decode(np.asarray(part.flatten()), counts)], pa.binary())], ["id", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return in_arrow(rows, decode, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def codec_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, then decodes the ids.

    The digests are of the decimal ids joined by commas and of the decoded bytes. Null text is empty: no
    tokens, digests of nothing. One pass without a shuffle, a few megabytes of text at a time.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(utf8(text)[1], 1 << 20):
                ids, counts = codec.encode(text[a:b].to_pylist())
                shas = [[hashlib.sha256(x).hexdigest() for x in f(ids, counts)] for f in (codec.decimals, codec.decode)]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(counts), *map(pa.array, shas)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return in_arrow(rows, digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
