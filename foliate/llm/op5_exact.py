"""Exact deduplication with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, fresh, in_arrow, parted, written
from foliate.session import ship

_SPACE = b" \t\n\x0b\x0c\r"


def normal(text: str | None) -> bytes:
    """UTF-8 with every run of `[\\x20\\x09-\\x0D]` replaced by one space; null counts as empty."""
    data = (text or "").encode()
    if not data:
        return data
    core = b" ".join(data.split())
    if not core:
        return b" "
    return (b" " if data[0] in _SPACE else b"") + core + (b" " if data[-1] in _SPACE else b"")


def directory(rows: dict[int, int], weight: dict[int, int], bits: int, capacity: int, heavy: int) -> list[tuple[int, int]]:
    """Splits overfull buckets until each holds at most `capacity` rows and `heavy` bytes, or is `bits` deep.

    rows and weight are per prefix of `bits` bits. A bucket is a prefix and its local depth; a split doubles
    what the directory has for it. Gives the first key prefix and the depth of every bucket, in key order.
    """
    prefixes = sorted(rows)
    n, w = (np.concatenate([[0], np.cumsum([x[p] for p in prefixes])]) for x in (rows, weight))
    out, stack = [], [(0, 0)]
    while stack:
        low, d = stack.pop()
        a, b = np.searchsorted(prefixes, [low, low + (1 << (bits - d))])
        if d < bits and (n[b] - n[a] > capacity or w[b] - w[a] > heavy):
            stack += [(low + (1 << (bits - d - 1)), d + 1), (low, d + 1)]
        else:
            out.append((low, d))
    return out


def _entries(id_at: int, text_at: int, key_bits: int):
    """Rows to index entries: equal texts of a batch are chained to the one with the smallest id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1)
            uid, ids, texts = batch.column(0).to_pylist(), row.field(id_at).to_pylist(), row.field(text_at).to_pylist()
            first: dict[bytes, int] = {}
            normals = [normal(x) for x in texts]
            for k, data in enumerate(normals):  # dictionaries compare bytes
                have = first.setdefault(data, k)
                if ids[k] is not None and (ids[have] is None or (ids[k], uid[k]) < (ids[have], uid[have])):
                    first[data] = k
            shas = {data: hashlib.sha256(data).digest() for data in first}
            sha = [shas[data] for data in normals]
            key = [int.from_bytes(x[:8], "big") >> (64 - key_bits) << (64 - key_bits) for x in sha]
            mine = [first[data] for data in normals]
            rep = np.array([k == m for k, m in enumerate(mine)])
            kept = pa.array(np.where(rep, np.arange(len(rep)), -1))
            kept = row.take(pc.if_else(pc.less(kept, 0), None, kept))
            yield pa.record_batch(
                [pa.array(uid), row.field(id_at), pa.array([uid[m] for m in mine]), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array([len(x) for x in normals], pa.int64()), pa.array([x.hex() for x in sha]), kept],
                ["uid", "id", "rep", "key", "bytes", "sha", "row"],
            )

    return read


def _own(table: pa.Table) -> pa.Table:
    """Owner task of a bucket: chains entries of equal keys, compares their bytes, names each class by its first entry."""
    order = np.lexsort((table.column("uid").to_numpy(), table.column("key").to_numpy()))
    key, uid = table.column("key").to_numpy()[order], table.column("uid").to_numpy()[order]
    texts = table.column("text").combine_chunks().take(pa.array(order))
    head = np.empty(len(key), np.int64)
    start = 0
    for end in [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]:
        chain: dict[bytes, int] = {}
        for k in range(start, end):
            head[k] = chain.setdefault(normal(texts[k].as_py()), uid[k])
        start = end
    return pa.table({"uid": uid, "head": head})


def _heads(texts: DataFrame, longest: int, page: int = 1000) -> DataFrame:
    """(uid, head) of chained entries. A chain of more than `page` entries is first worked on in pages, whose heads are chained again."""
    ship(texts.sparkSession)
    pages, found = -(-longest // page), None
    while True:
        groups = texts.groupBy("bucket", F.pmod(F.xxhash64("uid"), F.lit(max(1, pages))).alias("page"))
        heads = groups.applyInArrow(_own, "uid long, head long")
        if found is None:
            found = heads
        else:
            found = found.join(heads.toDF("head", "top"), "head").select("uid", F.col("top").alias("head"))
        if pages <= 1:
            return found
        found = written(found, "pages")
        texts = texts.join(found.where("uid = head").select("uid"), "uid", "left_semi")
        pages = pages // page


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = 1_000_000, heavy: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(entries, classes) of df's rows.

    entries, written on shared files, one for each row of df: uid, id, rep (uid of the batch's entry with an equal text),
    key, bytes, sha and the row itself where uid = rep. classes(rep, keep_uid, keep_id, group_size).

    Keys are ranges of a directory that doubles where a bucket is overfull; a histogram of key prefixes, of
    at most 2^16 rows at a time, tells which. Only keys that more than one entry has are chained: their texts
    go to the owner task of their range, which compares bytes, in pages where a chain is long. Equal
    texts of a batch are one entry before anything is shuffled, so a text that fills a third of the table
    gives an entry a batch.
    """
    names = df.columns
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kind = df.schema[id_col].dataType.simpleString()
    read = _entries(names.index(id_col), names.index(text_col), key_bits)
    entries = written(in_arrow(rows, read, f"uid long, id {kind}, rep long, key long, bytes long, sha string, row {rows.schema['row'].dataType.simpleString()}"), "entries")
    reps = entries.where("uid = rep").select("uid", "id", "key", "bytes")
    shared = reps.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chained = written(reps.join(shared, "key").select("uid", "key", "bytes", "n"), "chained")
    texts = entries.where("uid = rep").select("uid", F.col(f"row.`{text_col}`").alias("text")).join(chained.select("uid", "key"), "uid")
    heads = _heads(_placed(texts, _buckets(chained, capacity, heavy)), chained.agg(F.max("n")).first()[0] or 0)
    sizes = entries.groupBy(F.col("rep").alias("uid")).agg(F.count("*").alias("size"))
    whole = reps.select("uid", "id").join(sizes, "uid").join(heads, "uid", "left").withColumn("head", F.coalesce("head", "uid"))
    whole = written(whole, "heads")
    drop(chained)
    classes = whole.groupBy("head").agg(F.sum("size").alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"))
    classes = whole.select(F.col("uid").alias("rep"), "head").join(classes, "head").select("rep", F.col("first.uid").alias("keep_uid"), F.col("first.id").alias("keep_id"), "group_size")
    return entries, classes


def _buckets(chained: DataFrame, capacity: int, heavy: int) -> list[int]:
    """The first key of every bucket, in signed order."""
    prefixes = chained.select(F.shiftrightunsigned("key", 48).alias("prefix"), "bytes")
    counted = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("bytes").alias("w")).collect()  # 65,536 rows at most
    buckets = directory({r[0]: r[1] for r in counted}, {r[0]: r[2] for r in counted}, 16, capacity, heavy)
    keys = [low << 48 for low, _ in buckets]
    return sorted(key - (1 << 64) if key >= 1 << 63 else key for key in keys)


def _placed(texts: DataFrame, starts: list[int]) -> DataFrame:
    bounds = np.array(starts, np.int64)
    schema = texts.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column("key").to_numpy(), "right")
            yield batch.append_column("bucket", pa.array(at.astype(np.int32)))

    return in_arrow(texts, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", bucket int")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of df, dropped ones too.

    Texts are equal when their bytes are after white space is made single. The row with the smallest id
    stays; rows without an id come after all others. Of rows with the same id and text one stays. Null text
    is empty, and empty texts are equal to each other. Columns of any name may be beside these.
    """
    entries, classes = index(df, id_col, text_col, **how)
    out = entries.select("uid", "id", "rep", "sha").join(classes, "rep")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of df that stay, with all columns as they were."""
    entries, classes = index(df, id_col, text_col, **how)
    gone = written(classes.where("rep <> keep_uid").select(F.col("rep").alias("uid"), F.xxhash64("rep").alias("hash")), "gone")
    row, hash_ = fresh(df, "row", "hash")
    stored = entries.where("uid = rep").select("uid", F.xxhash64("uid").alias(hash_), F.col("row").alias(row))
    sure, rest = parted(stored, hash_, gone.select("hash"))
    return sure.union(rest.join(gone.select("uid"), "uid", "left_anti").select(stored.columns)).select(f"{row}.*")
