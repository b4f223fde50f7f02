"""Near-duplicates among vectors by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import met, union, written
from foliate.llm.components import resolved
from foliate.session import ship

#: Rows of a product: its matrix of ROWS x ROWS floats is what a task holds beside its two blocks.
ROWS = 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, length, error): unit is near scale * q, of that length, and at most `error` away from it.

    The error is that of each vector, measured in double precision and raised by more than its rounding.
    """
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1) * (1 + 1e-9) + 1e-12


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers within int8: sums over up to 1,024 components stay below 2^24, where floats are exact."""
    out = (a[:, :1024] @ b[:, :1024].T).astype(np.float64)
    for k in range(1024, a.shape[1], 1024):
        out += a[:, k : k + 1024] @ b[:, k : k + 1024].T
    return out


def _tiles(threshold: float):
    def tile(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (x.as_py() for x in key[:2])
        cid, block, size = (table.column(n).to_numpy() for n in ("cid", "block", "size"))
        order = np.lexsort((cid, block))
        cid, block, size = cid[order], block[order], size[order]
        flat = table.column("vec").combine_chunks().take(pa.array(order))
        full = flat.flatten().to_numpy().reshape(len(cid), -1).astype(np.float64)
        # a power of two first: squares of very large or small components stay finite
        full = full * np.exp2(-np.frexp(np.abs(full).max(1))[1])[:, None]
        norm = np.linalg.norm(full, axis=1)
        q, scale, length, error = quantised(full / norm[:, None])
        cut = int(np.searchsorted(block, b)) if a != b else 0
        links, labels = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i in range(0, cut if a != b else len(cid), ROWS):
            ie = min(i + ROWS, cut) if a != b else i + ROWS
            qi = q[i:ie].astype(np.float32)
            for j in range(cut if a != b else i, len(cid), ROWS):
                je = j + ROWS
                near = _product(qi, q[j:je].astype(np.float32)) * (scale[i:ie, None] * scale[None, j:je])
                bound = length[i:ie, None] * error[None, j:je] + error[i:ie, None] * length[None, j:je] + error[i:ie, None] * error[None, j:je] + 1e-9
                x, y = np.nonzero(near + bound >= threshold)
                sure = near[x, y] - bound[x, y] >= threshold
                x, y = x + i, y + j
                if a == b and i == j:
                    x, y, sure = x[x < y], y[x < y], sure[x < y]
                for k in range(0, len(x), 1 << 16):  # those that the bounds leave open, in double precision
                    open_ = np.flatnonzero(~sure[k : k + (1 << 16)]) + k
                    sure[open_] = np.einsum("ij,ij->i", full[x[open_]], full[y[open_]]) / (norm[x[open_]] * norm[y[open_]]) >= threshold
                x, y = x[sure], y[sure]
                links += np.bincount(x, size[y], len(cid)).astype(np.int64) + np.bincount(y, size[x], len(cid)).astype(np.int64)
                union(labels, x, y)
        on = links > 0
        return pa.table({"cid": cid[on], "links": links[on], "root": cid[labels[on]]})

    return tile


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df: links are pairs with cosine >= threshold.

    Equal vectors are one class before any product; a class counts with its rows, so copies aren't expanded.
    Classes are dealt evenly into blocks of about block_rows, and every pair of blocks of one length is a tile.
    A tile sends back for each row its number of links and the least class that its own links reach, never
    pairs: what it sends is bounded by its rows. The bounds of quantisation hold for each vector, so no
    link is lost: pairs surely at or over the threshold count, those that may be are computed in double precision.

    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing: it has
    0 links and is its own component. Rows with a null id link as any other, but never name a component unless it has
    no other row. Repeated ids are kept as separate rows. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    classes = written(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    blocks = max(1, -(-classes.count() // block_rows))
    dealt = classes.select("cid", "size", "vec", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), F.size("vec").alias("dim"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = dealt.withColumn("other", other).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    ship(df.sparkSession)
    found = written(pairs.groupBy("a", "b", "dim").applyInArrow(_tiles(threshold), "cid long, links long, root long"), "found")
    ends = written(classes.select("vec", "cid").join(resolved(classes, found), "cid").drop("cid"), "ends")
    total = ends.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    linked = met(good, ends, ["vec"], "size", total).select("id", "n_links", "component_id")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).withColumn("component_id", F.col("component_id").cast(kind))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
