"""Best-fit packing of token sequences by hierarchical residual merging."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.bpe import SPECIAL, Splitter, Store, texts_to_ids
from foliate.llm.common import in_arrow, slices, text_of, utf8, written

_STORES: dict[str, tuple[Splitter, Store, int]] = {}
ITEM = "uid: bigint, size: int, offset: int"
#: Pre-tokens that the library gets as one text.
_JOINED = 128


def _tokenizer(path: str) -> tuple[Splitter, Store, int]:
    if path not in _STORES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = tokenizer.token_to_id(SPECIAL)

        def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Many pre-tokens are one text for the library, parted by the special string, which no pre-token holds."""
            texts = [SPECIAL.join([*new[k : k + _JOINED], ""]) for k in range(0, len(new), _JOINED)]
            ids = np.concatenate([np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == special)
            return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

        _STORES[path] = Splitter(public_tokenizers.PATTERN), Store(encode), special
    return _STORES[path]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = 1024, end: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every piece of at most `length` tokens of every document.

    A document is its ids by the tokenizers library, each distinct pre-token encoded once per worker, then
    the id `end`. Only longer ones are cut: all pieces but the first are full. Null text is empty: one piece
    with the end id alone. No shuffle.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, store, special = _tokenizer(path)
        for batch in batches:
            text = batch.column(1)
            for a, b in slices(utf8(text)[1], 1 << 21):
                ids, counts = texts_to_ids(text[a:b].to_pylist(), split, store, (SPECIAL, special))
                ends = np.cumsum(counts)
                data = memoryview(np.insert(ids, ends, end).astype("<u4")).cast("B")
                total = counts + 1
                base = np.cumsum(total) - total
                n = -(-total // length)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = total - (n - 1) * length  # of the first piece
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * length)
                size = np.where(piece == 0, short[doc], length)
                at = (base[doc] + start) * 4
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + size * 4).tolist(), strict=True)]
                yield pa.record_batch([batch.column(0)[a:b].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return in_arrow(rows, cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of every bin. A bit set of the room that bins have finds the fullest bin that fits."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free = 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[k]
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        left = room - size
        rooms[left].append(b)
        free |= 1 << left
    return bins


def _packer(capacity: int, nearly: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        fill = table.column("fill").to_numpy().tolist()
        items = table.column("items").chunk(0)
        starts = np.asarray(items.offsets)
        values = items.values
        uid, size, offset = (values.field(k).to_numpy() for k in range(3))
        order: list[int] = []
        shift: list[int] = []
        ends, fills = [0], []
        for own in _best_fit(fill, capacity):
            at = 0
            for k in own:
                order.extend(range(starts[k], starts[k + 1]))
                shift.extend([at] * (starts[k + 1] - starts[k]))
                at += fill[k]
            ends.append(len(order))
            fills.append(at)
        take = np.array(order, np.int64)
        struct = pa.StructArray.from_arrays([pa.array(uid[take]), pa.array(size[take]), pa.array((offset[take] + np.array(shift)).astype(np.int32))], ["uid", "size", "offset"])
        fills = np.array(fills)
        yield pa.record_batch([pa.array(fills.astype(np.int32)), pa.array(fills >= nearly), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["fill", "full", "items"])

    return pack


def pack(items: DataFrame, capacity: int = 1024, nearly: float = 0.995, per_task: int = 100_000, fan_in: int = 8) -> DataFrame:
    """Packs items(uid unique long, size int of 1 to capacity): (uid, sequence_id, offset).

    Every partition packs its items best-fit, largest first, and gives off bins filled to `nearly`; underfull
    bins go on as items of a smaller number of partitions, by `fan_in` each round, of at most about
    `per_task` bins in one task. It ends with one partition, or when a round doesn't lower the number of
    underfull bins by a hundredth: then no more bins fit together. A bin takes the uid of its first item.
    """
    schema = f"fill int, full boolean, items array<struct<{ITEM}>>"
    left = items.select(F.col("size").cast("int").alias("fill"), F.array(F.struct(F.col("uid"), F.col("size").cast("int").alias("size"), F.lit(0).alias("offset"))).alias("items"))
    packer, out = _packer(capacity, int(capacity * nearly)), []
    count = left.count()
    parts = max(1, -(-count // per_task), min(left.rdd.getNumPartitions(), -(-count // 2000)))
    while True:
        done = written(in_arrow(left.repartition(parts), packer, schema), "bins")
        out.append(done.where("full"))
        under = done.where("not full").select("fill", "items")
        before, count = count, under.count()
        if parts == 1 or not count or (len(out) > 1 and count > 0.99 * before):
            out.append(under)
            break
        parts = max(-(-parts // fan_in), -(-count // per_task))
        left = under
    bins = out[0].select("items")
    for more in out[1:]:
        bins = bins.union(more.select("items"))
    return bins.select(F.col("items")[0]["uid"].alias("sequence_id"), F.explode("items").alias("i")).select("i.uid", "sequence_id", F.col("i.offset").cast("long").alias("offset"))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = 1024, end: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): all pieces of all documents, packed.

    Full pieces are sequences of their own. Null ids, repeated rows and empty texts are packed as any other
    row; an empty table gives no rows. Other columns are not read.
    """
    cut = written(pieces(df, id_col, text_col, path, length, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < length)
    rest = rest.join(pack(rest.select("uid", F.col("length").alias("size")), length), "uid")
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(names).union(rest.select(names)).withColumnRenamed("id", id_col)
