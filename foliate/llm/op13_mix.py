"""Mixing sources to target weights: repetition rates from grouped sizes, whole copies and one hash-seeded coin for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, fresh, in_arrow, met, slices, text_of, utf8, written

#: Coins that each source may choose from.
SEEDS = 64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of column text, counted in bytes; about 8 MB of text at a time."""
    for batch in batches:
        text = batch.column("text")
        data, offsets = utf8(text)
        n = np.zeros(len(text), np.int64)
        for a, b in slices(offsets, 1 << 23):
            for low in range(offsets[a], offsets[b], 1 << 23):  # of one long text a stretch at a time
                high = min(low + (1 << 23), offsets[b])
                gap = _GAP[data[low:high]]
                begins = ~gap
                begins[1:] &= gap[:-1]
                if low > offsets[a] and not _GAP[data[low - 1]]:
                    begins[0] = False
                starts = offsets[a:b] - low
                inside = (starts >= 0) & (starts < high - low) & (offsets[a + 1 : b + 1] > offsets[a:b])
                first = starts[inside]
                begins[first] = ~gap[first]
                at = np.flatnonzero(begins) + low
                np.add.at(n, np.searchsorted(offsets[1:], at, "right"), 1)
        yield pa.record_batch([batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"] + [pa.array(n)], [c for c in batch.schema.names if c != "text"] + ["size"])


def _group(source: str = "source") -> Column:
    """A key for the source of a row that is never null: null and empty sources are two."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))


def sizes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, source, mark, coin, size) of every row: mark is a key of the source, coin a hash of key and text, size the number of words."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col("source"), _group().alias("mark"), F.xxhash64(F.col(key), F.col("text")).alias("coin"), text_of("text").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(rows, _sized, f"doc_id {kind}, source string, mark string, coin long, size long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place: 0, 1, ... by the column source in the order of code points, null last. Sorted by ranges, numbered in each of them."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("source").isNull()
    parts = sources.repartitionByRange(n, last, "source").sortWithinPartitions(last, "source")
    # the low 33 bits of this id number the rows of a partition, the others number the partitions
    parts = written(parts.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts, before, seen = parts.groupBy(part.alias("part")).count().orderBy("part").collect(), [], 0
    for r in counts:
        before.append((r["part"], seen))
        seen += r["count"]
    offsets = F.broadcast(sources.sparkSession.createDataFrame(before, "part long, before long"))
    return parts.withColumn("part", part).join(offsets, "part").withColumn("place", F.col("before") + row).drop("part", "before", "at")


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): `share` of all sizes by weights, which repeat in the order of sources.

    A target stops at `most` times its source's size; what is over goes to the others by weight, until none is above. Every round is one
    sum over the sources that have not stopped; only the price of a unit of weight goes on to the next round.
    """
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    cap = F.col("source_size") * F.lit(float(most))
    rows = written(ranked(sources).withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", cap), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    price, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(price)
        n, taken, weight = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not weight:
            break
        stopped, price = n, (share * total - (taken or 0.0)) / weight
    if not weight:
        price = float("inf")
    return rows.select("source", "source_size", F.least("cap", F.when(F.col("weight") > 0, F.col("weight") * F.lit(price)).otherwise(0.0)).alias("target"))


def _heads(coin: str, seed: int | Column, fraction: Column) -> Column:
    """Whether the coin of a row falls on its copy: 53 bits of a hash of coin and seed, below the fraction."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.shiftrightunsigned(F.xxhash64(coin, seed), 11).cast("double") * F.lit(2.0**-53) < fraction


def rates(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seeds: int = SEEDS) -> DataFrame:
    """(mark, source, source_size, target, rate, fraction, seed, n) of every source of sizes(); n is its number of rows.

    The rate is target / source_size (no words: 0), fraction what is over its whole number. Of `seeds` coins a source takes the one whose
    words come nearest to its target (the first of equals): sources of few or very unequal documents would else be far off. All seeds
    are summed in one pass of numbers only, combined before they are shuffled.
    """
    found = written(rows.groupBy("mark").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")), "found")
    aim = targets(found.select("source", "source_size"), weights, share, most).select(_group().alias("mark"), "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = written(found.join(aim, "mark").withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate")), "rates")
    drop(found)
    total = each.agg(F.sum("n")).first()[0] or 0
    tried = F.array(*(F.sum(F.when(_heads("coin", k, F.col("fraction")), F.col("size")).otherwise(0)) for k in range(seeds)))
    known = met(rows.select("mark", "coin", "size"), each.where("fraction > 0").select("mark", "fraction", "n"), ["mark"], "n", total)
    open_ = known.groupBy("mark").agg(tried.alias("tried")).join(each.select("mark", (F.col("fraction") * F.col("source_size")).alias("aim")), "mark")
    off = F.transform("tried", lambda x: F.abs(x - F.col("aim")))
    seed = open_.select("mark", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("seed"))
    out = written(each.join(seed, "mark", "left").withColumn("seed", F.coalesce("seed", F.lit(0))), "seeds")
    drop(each)
    return out


def _often(coin: str, rate: str, fraction: str, seed: str) -> Column:
    return (F.floor(rate) + _heads(coin, F.col(seed), F.col(fraction)).cast("int")).cast("int")


def copies(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row of docs(key, text, source).

    size counts the runs of `[^\\x20\\x09-\\x0D]` (null text: 0). Each document is taken floor(rate) times and once more if a coin, a hash
    of key, text and its source's seed, falls below the fraction; rates() says more of both and takes the settings. Rows equal in key and
    text have one coin. Other columns, whatever their names, aren't read. Texts are read once and not shuffled; sources with over a
    1,024th of the rows are joined by broadcast. No rows: none. Reruns agree.
    """
    rows = written(sizes(docs, key), "sizes")
    each = rates(rows, **settings)
    known = met(rows, each.drop("source"), ["mark"], "n", each.agg(F.sum("n")).first()[0] or 0)
    out = known.withColumn("copies", _often("coin", "rate", "fraction", "seed"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as often as copies() takes them, plus copy: 1, 2, ...; the last column's name gets _ where it is taken."""
    rows = written(sizes(docs, key), "sizes")
    each = rates(rows, **settings)
    drop(rows)
    names = dict(zip(("mark", "coin", "rate", "fraction", "seed", "n"), fresh(docs, "mark", "coin", "rate", "fraction", "seed", "n"), strict=True))
    (copy,) = fresh(docs, "copy")
    own = each.select(*(F.col(c).alias(names[c]) for c in ("mark", "rate", "fraction", "seed", "n")))
    marked = docs.withColumns({names["mark"]: _group(), names["coin"]: F.xxhash64(F.col(key), F.col("text"))})
    known = met(marked, own, [names["mark"]], names["n"], each.agg(F.sum("n")).first()[0] or 0)
    often = _often(*(names[c] for c in ("coin", "rate", "fraction", "seed")))
    return known.withColumn(copy, F.explode(F.when(often > 0, F.sequence(F.lit(1), often)))).select(*docs.columns, copy)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of copies() with its own weights."""
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken")
