"""What the operators of this subpackage share: written tables, fresh names, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliate.session import ship


#: Bits of the maps that parted() sends to every task: 8 MB.
BITS = 26


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where that is unset and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_foliate_shared", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._foliate_shared = "file://" + tempfile.mkdtemp(prefix="foliate-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors.

    The files go when the driver's JVM ends, or earlier by drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliate/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliate_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that written() gave and that no later plan reads."""
    path = getattr(df, "_foliate_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow after the package is with the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def met(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, parts: int = 1024) -> DataFrame:
    """left inner join right on keys, which are unique and not null in right; n, a column of right, tells how many rows of left a key has.

    Keys with over a `parts`-th of `total`, the rows of left, are hot: as there are fewer than `parts` of them, they go to every task
    and their rows stay where they are. All other rows are shuffled. left and right are read twice.
    """
    hot = F.col(n) > total / parts
    few = F.broadcast(right.where(hot))
    return left.join(few, keys).union(left.join(few.select(*keys), keys, "left_anti").join(right.where(~hot), keys))


def parted(df: DataFrame, key: str, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key is surely not in hashes(long), all other rows); key is a well mixed hash without nulls.

    The hashes are told apart by a map of 2^BITS bits, of one size however many they are; with so many that most bits are set,
    the second part has most rows. Nothing of df is shuffled; df is read once for either part.
    """
    spark = df.sparkSession
    spot = hashes.select(F.shiftrightunsigned(hashes.columns[0], 64 - BITS).alias("spot"))
    words = spot.groupBy(F.shiftright("spot", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    shared, at = spark.sparkContext.broadcast(table.view(np.uint64)), df.columns.index(key)

    def only(hit: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(at).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
                on = (shared.value[own >> np.uint64(6)] >> (own & np.uint64(63))) & np.uint64(1)
                yield batch.filter(pa.array((on == 1) == hit))

        return keep

    return in_arrow(df, only(False), df.schema), in_arrow(df, only(True), df.schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and the offsets of its values, without copies of single texts."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose values together have about size elements; at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0]+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs give equal outputs, others look random."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i[k] and j[k]; labels point to the least member of each set."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
