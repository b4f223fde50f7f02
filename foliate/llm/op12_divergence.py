"""Source divergence audit: sorted (term id, count) arrays of two groups meet in tasks of their pairs, block of terms by block of terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import drop, in_arrow, met, text_of, written
from foliate.session import ship

#: Documents of a language that must have a term; ranks of the terms reported.
LEAST, RANKS = 10, 10
#: Bits of the hash that puts terms into fine blocks; terms of a block of arrays; sources that share a side of a task.
BITS, BLOCK, BUNDLE = 16, 1 << 14, 8
#: Distinct (group, term) counts that a task holds before it hands them on; bytes of a text taken at a time.
HELD, PIECE = 500_000, 1 << 22
#: A term is a run of ASCII letters and of bytes of other characters.
_TERM, _GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
UNIT = 1_000_000_000


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in stretches of about PIECE bytes, none of which ends inside a term."""
    low = 0
    while low < len(data):
        gap = _GAP.search(data, low + PIECE) if low + PIECE < len(data) else None
        high = gap.start() if gap else len(data)
        yield data[low:high]
        low = high


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to (lang, source, term, count, docs), summed over many documents before they are handed on."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in groups.items():
            if count:
                n = len(count)
                terms = pa.array(list(count), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * n), pa.array([source] * n), terms, pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())], ["lang", "source", "term", "count", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            count, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in _pieces(data):
                terms = _TERM.findall(piece.lower())
                count.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(c) for c, _ in groups.values()) > HELD:
            yield from given()
    yield from given()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, block, place, term, count, lang_count): every term of at least `least` documents of its language, by group that has it.

    Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z lower-cased. block is a hash of the term, place its
    number in the block by the order of code points. One shuffle, by language and block: a hot language has 2^BITS parts.
    """
    raw = in_arrow(docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text")), _counted, "lang string, source string, term string, count long, docs long")
    block = F.shiftrightunsigned(F.xxhash64("term"), 64 - BITS).cast("int")
    summed = raw.withColumn("block", block).repartition("lang", "block").groupBy("lang", "block", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "block", "term")
    totals = summed.withColumns({"lang_count": F.sum("count").over(term), "lang_docs": F.sum("docs").over(term)}).where(F.col("lang_docs") >= least)
    return totals.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term"))).select("lang", "source", "block", "place", "term", "count", "lang_count")


def priced(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for any long counts."""
    over = total + 2 * terms
    short = F.call_function("div", F.lit(UNIT) * (count + 2), over)
    long_ = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), over.cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, short).otherwise(long_) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def price(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """priced() of an array; three decimal digits a step, so exact for totals below 9 * 10^15."""
    over = total + 2 * terms
    out, rest = np.divmod(np.asarray(count, np.int64) + 2, over)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digits
    return out + 1


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Side:
    """What a task knows of one group in a block: its sorted array, prices, and how often it has each count."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int, terms: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.price = ids[order], price(counts[order], total, terms)
        self.zero = int(price(np.zeros(1), total, terms)[0])
        levels, self.often = np.unique(counts, return_counts=True)
        self.levels = price(levels, total, terms)


def merged(a: _Side, b: _Side, terms: int) -> int:
    """Sum over the terms of a block that has `terms` of them. Few distinct counts price the terms of one side alone; the search of the
    shorter array in the longer one finds the terms of both, which are priced anew; the absent ones have one price."""
    one = int((_far(a.levels, b.zero) * a.often).sum()) + int((_far(b.levels, a.zero) * b.often).sum())
    short, long_ = (a, b) if len(a.ids) <= len(b.ids) else (b, a)
    at = np.searchsorted(long_.ids, short.ids)  # sorted needles: each search starts where the last one ended
    inside = at < len(long_.ids)
    inside[inside] = long_.ids[at[inside]] == short.ids[inside]
    p, q = short.price[inside], long_.price[at[inside]]
    both = int((_far(p, q) - _far(p, long_.zero) - _far(q, short.zero)).sum())
    none = terms - len(a.ids) - len(b.ids) + len(p)
    return one + both + none * int(_far(np.int64(a.zero), np.int64(b.zero)))


def _sides(table: pa.Table) -> dict[int, tuple[str, _Side | None]]:
    found: dict[int, list] = {}
    for k, source, total, terms, ids, counts in zip(*(table.column(c).to_pylist() if c not in ("ids", "counts") else table.column(c) for c in ("k", "source", "total", "terms", "ids", "counts")), strict=True):
        at = found.setdefault(k, [source, total, terms, [], []])
        at[3].append(ids.values.to_numpy())
        at[4].append(counts.values.to_numpy())
    return {k: (source, _Side(np.concatenate(ids), np.concatenate(counts), total, terms) if terms else None) for k, (source, total, terms, ids, counts) in sorted(found.items())}


def _met(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of the groups of two bundles, the first of a pair having the smaller number."""
    here, there = _sides(left), _sides(right)
    rows, terms = [], max([0, *left.column("in_block").to_pylist()])
    for i, (source, a) in here.items():
        for j, (other, b) in there.items():
            if i < j:
                rows.append((key[0].as_py(), source, other, merged(a, b, terms) if a else 0))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source); nulls are read as ''.

    A group is a language and a source that occur together, even without terms. Each term kept by its language has in each group the
    price p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two prices are floor((p - q)^2 / (p + q)) apart. Part `pair`: each other source of
    the language, with the sum over all kept terms (0 if there are none). Part `term`: the `ranks` terms of the group that are furthest
    above their language's price. Ranks go by value, then by the item's code points. Repeated rows count as often as they occur. Very long texts are read in stretches; extra
    columns aren't read; no rows give no rows.

    Counts are summed in tasks before they are shuffled, and a group has one count a term after it, so a hot source weighs little more
    than others. Arrays have at most about BLOCK terms; the sources of a language go in bundles of BUNDLE, and a task gets two bundles of
    one block, so an array is sent once a bundle of its language and not once a source. The result itself has a row for each pair.
    """
    spark = docs.sparkSession
    kept = written(kept_terms(docs, least), "terms")
    blocks = kept.groupBy("lang", "block").agg(F.max("place").cast("long").alias("terms"), F.sum("count").alias("count"))
    langs = blocks.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("count").alias("lang_total"))
    have = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("n"))
    every = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct().join(have, ["lang", "source"], "left").join(langs, "lang", "left")
    k = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(every.select("lang", "source", k.alias("k"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n", "terms", "lang_total"))), "groups")
    parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int")
    known = met(kept, groups.where("n > 0"), ["lang", "source"], "n", groups.agg(F.sum("n")).first()[0] or 0)

    p, q = priced(F.col("count"), F.col("total"), F.col("terms")), priced(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    above = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))

    at = F.shiftright(F.col("block").cast("long") * parts, BITS).cast("int")
    one = F.struct((F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")).alias("id"), F.col("count"))
    side = ["lang", "source", "k", "total", "terms", "at"]
    full = known.withColumn("at", at).groupBy(*side).agg(F.sort_array(F.collect_list(one)).alias("a")).select(*side, F.col("a.id").alias("ids"), F.col("a.count").alias("counts"))
    none = F.array().cast("array<bigint>")
    empty = groups.withColumn("at", F.explode(F.sequence(F.lit(0), parts - 1))).select(*side, none.alias("ids"), none.alias("counts"))
    sizes = groups.select("lang", parts.alias("parts")).distinct()
    in_block = blocks.join(sizes, "lang").select("lang", F.shiftright(F.col("block").cast("long") * F.col("parts"), BITS).cast("int").alias("at"), "terms").groupBy("lang", "at").agg(F.sum("terms").alias("in_block"))
    arrays = full.union(empty).join(in_block, ["lang", "at"], "left").withColumn("in_block", F.coalesce("in_block", F.lit(0)))
    last = groups.groupBy("lang").agg(F.floor(F.max("k") / BUNDLE).cast("int").alias("last"))
    arrays = written(arrays.join(last, "lang").withColumn("bundle", F.floor(F.col("k") / BUNDLE).cast("int")), "arrays")
    left = arrays.withColumn("i", F.col("bundle")).withColumn("j", F.explode(F.sequence("bundle", "last")))
    right = arrays.withColumn("j", F.col("bundle")).withColumn("i", F.explode(F.sequence(F.lit(0), "bundle")))
    ship(spark)
    task = ["lang", "at", "i", "j"]
    sums = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_met, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value").withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(terms.select(*columns))
