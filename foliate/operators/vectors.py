"""Vector search: exact cosine top-k of many queries at once, by products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.session import ship


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(table: pa.Table, name: str) -> np.ndarray:
    x = table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(k: int):
    def tile(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        q, d = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        ids, own = d.column("id").to_numpy(), q.column("id").to_numpy()
        if not len(ids) or not len(own):
            return pa.table({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], _unit(d, "vec")[order]
        out_q, out_i, out_s = [], [], []
        for start in range(0, len(own), 256):
            s = np.round(_unit(q.slice(start, 256), "vec") @ rows.T, 12)
            s[own[start : start + 256, None] == ids[None, :]] = -np.inf
            if k < s.shape[1]:  # all that reach the k-th value, of which the first by id stay
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                row, col = np.nonzero(s >= least[:, None])
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                best = col[nth < k].reshape(len(s), k)
            else:
                best = np.argsort(-s, axis=1, kind="stable")
            value = np.take_along_axis(s, best, 1)
            r, c = np.nonzero(np.isfinite(value))
            out_q.append(own[start + r]), out_i.append(ids[best[r, c]]), out_s.append(value[r, c])
        return pa.table({"qid": np.concatenate(out_q), "id": np.concatenate(out_i), "similarity": np.concatenate(out_s)})

    return tile


def nearest(queries: DataFrame, data: DataFrame, id_col: str, vec_col: str, k: int, block: int = 8192) -> DataFrame:
    """(qid, id, similarity, rank): the k rows of data nearest to each query by cosine, itself left out; ties by id.

    Exact: queries and data are dealt into blocks, every pair of blocks is a tile of one matrix product that sends back k
    rows a query, and those are ranked again. Nothing is broadcast; work is queries times data in blocks.
    """
    sound = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0), F.lit(False))
    q = queries.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    d = data.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    nq, nd = (max(1, -(-x.count() // block)) for x in (q, d))
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)))
    left = deal(q, nq, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nd - 1)).cast("array<bigint>"))).withColumn("side", F.lit(0))
    right = deal(d, nd, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>"))).withColumn("side", F.lit(1))
    ship(q.sparkSession)
    tiles = left.unionByName(right).withColumn("dim", F.size("vec")).groupBy("a", "b", "dim").applyInArrow(_nearest(k), "qid bigint, id bigint, similarity double")
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return tiles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_of_each(ranked: DataFrame, groups: DataFrame, id_col: str, group: str, n: int) -> DataFrame:
    """Overfetched rows deduplicated per group after ranking: the best row of each, n groups a query."""
    own = ranked.join(groups.select(F.col(id_col).cast("bigint").alias("id"), F.col(group).alias("grp")), "id")
    best = own.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "grp").orderBy("rank"))).where("_r = 1").drop("_r")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= n)


def mean_vectors(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """(group, mean array<double>): element-wise means; only rows of one element and group meet."""
    parts = df.select(group, F.posexplode(vec_col).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
