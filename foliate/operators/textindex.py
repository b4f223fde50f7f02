"""A positional text index in blocks: phrases, OR, negation and cover density from postings, reading only blocks that can enter the first rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import ranking
from foliate.operators.search import WEIGHTS, parse_query, terms
from foliate.session import ship
from foliate.storage import drop, scratch, written

#: Documents of a block; folders of postings; blocks read before a score to beat is known.
BLOCK, BUCKETS, FIRST = 1024, 64, 64
#: A position is kept as its number times four and the number of its part's weight.
CODES = {name: k for k, name in enumerate(WEIGHTS)}
_WORTH = list(WEIGHTS.values())


@dataclass
class TextIndex:
    """Postings (bucket, term, block, id, tf, positions), heads (bucket, term, block, docs, most, worth) and, after each query, what it read of them."""

    spark: SparkSession
    path: str
    key: str
    read: dict[str, int] = field(default_factory=dict)

    def _of(self, name: str, words: list[str]) -> DataFrame:
        """Rows of some terms: folders are chosen by the hash, files and pages in them by the sorted terms."""
        schema = f"term string, block long, {self.key}, bucket int" if name == "postings" else "term string, block long, docs long, most int, worth double, bucket int"
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets) & F.col("term").isin(words)).drop("bucket")

    def postings(self, words: list[str]) -> DataFrame:
        return self._of("postings", words)

    def heads(self, words: list[str]) -> DataFrame:
        return self._of("heads", words)


def _bucket() -> Column:
    return (F.crc32("term") % BUCKETS).cast("int")


def _posted(codes: list[int]):
    """(id, block, words of each part) to one row per document and term, all documents of a batch in one sort."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows, places, words = batch.num_rows, [], [], []
            before = np.zeros(n, np.int64)
            for k, code in enumerate(codes):
                part = batch.column(2 + k)
                at = part.offsets.to_numpy().astype(np.int64)
                size = np.diff(at)
                row = np.repeat(np.arange(n), size)
                rows.append(row)
                places.append((np.arange(at[-1] - at[0]) - (at[:-1] - at[0])[row] + before[row]) * 4 + code)
                words.append(part.values.slice(at[0], at[-1] - at[0]))
                before += size
            found = pa.concat_arrays(words).dictionary_encode()
            row, place, word = np.concatenate(rows), np.concatenate(places), found.indices.to_numpy()
            order = np.lexsort((place, word, row))
            row, place, word = row[order], place[order], word[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])]) if len(row) else np.zeros(0, np.int64)
            ends = np.r_[first, len(row)].astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            of = pa.array(row[first])
            yield pa.record_batch([found.dictionary.take(pa.array(word[first])), batch.column(1).take(of), batch.column(0).take(of), pa.array(np.diff(ends)), positions], ["term", "block", "id", "tf", "positions"])

    return post


def build(notes: DataFrame, id_col: str, parts: dict[str, str], path: str | None = None, block: int = BLOCK) -> TextIndex:
    """Indexes every word of every note; parts gives text columns and their weights A to D, whose words stand one part after the other.

    Words are those of search.terms(). Documents of about the same length share a block of about `block` documents, so that blocks of short
    ones have small bounds. A posting holds whole positions, however many; a note without words has none. id_col is a key. Postings are
    sorted by (bucket, term, block) over ranges, so a frequent word is spread over files. path: a folder that all executors share.
    """
    spark = notes.sparkSession
    path = path or scratch(spark, "index")
    length = reduce(lambda a, b: a + b, (F.length(F.coalesce(c, F.lit(""))) for c in parts))
    rows = notes.select(F.col(id_col).alias("id"), F.floor(4 * F.log2(length + 1)).cast("int").alias("size"), *(terms(F.col(c)).alias(f"p{k}") for k, c in enumerate(parts)))
    sizes = {r["size"]: -(-r["count"] // block) for r in rows.groupBy("size").count().collect()}  # at most 4 * 31 sizes of a text
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("size")), F.lit(1)) if sizes else F.lit(1)
    at = F.shiftleft(F.col("size").cast("long"), 40) + F.pmod(F.xxhash64("id"), many)
    kind = notes.schema[id_col].dataType.simpleString()
    key = f"id {kind}, tf int, positions array<int>"
    ship(spark)
    posted = rows.select("id", at.alias("block"), *(f"p{k}" for k in range(len(parts)))).mapInArrow(_posted([CODES[w] for w in parts.values()]), f"term string, block long, {key}")
    posted = posted.withColumn("bucket", _bucket())
    order = ["bucket", "term", "block", "id"]
    posted.repartitionByRange("bucket", "term", "block").sortWithinPartitions(*order).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    whole = spark.read.schema(f"term string, block long, {key}, bucket int").parquet(f"{path}/postings")
    worth = F.array_max(F.transform("positions", lambda x: F.element_at(F.array(*[F.lit(w) for w in _WORTH]), x % 4 + 1)))
    heads = whole.groupBy("bucket", "term", "block").agg(F.count("*").alias("docs"), F.max("tf").alias("most"), F.max(worth).alias("worth"))
    heads.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/heads")
    return TextIndex(spark, path, key)


def _unit(words: list[str]) -> Column:
    """First positions of a word or phrase in a document: those from which each next word follows at the next place of the same part."""
    back = lambda k: lambda x: x - 4 * k
    each = [F.transform(f"w.{w}", back(k)) for k, w in enumerate(words)]
    return F.coalesce(reduce(F.array_intersect, each), F.array().cast("array<int>"))


def keyword(index: TextIndex, query: str, limit: int) -> DataFrame:
    """(id, match, matched, score) as search.keyword() gives by reading all texts, from postings alone.

    First only blocks are read in which every group of the query has all words of one of its units; if these give fewer than `limit` rows
    with every group, all blocks that have any of them are. Phrases are held against positions; a negated unit excludes.
    """
    groups, nots = parse_query(query)
    words = sorted({w for g in [*groups, nots] for u in g for w in u})
    if not groups:
        return index.spark.createDataFrame([], f"{index.key.split(',')[0]}, matched int, score double, match string")
    name = {w: f"w{k}" for k, w in enumerate(words)}
    wanted = sorted({w for g in groups for u in g for w in u})
    has = index.heads(wanted).groupBy("block").agg(F.collect_set("term").alias("terms"))
    possible = [reduce(lambda a, b: a | b, (F.size(F.array_intersect("terms", F.array(*map(F.lit, set(u))))) == len(set(u)) for u in g)) for g in groups]
    marked = written(has.select("block", reduce(lambda a, b: a & b, possible).alias("full"), reduce(lambda a, b: a | b, possible).alias("some")), "blocks")
    postings = index.postings(words)

    def answered(blocks: DataFrame) -> DataFrame:
        near = postings.join(blocks.select("block"), "block", "left_semi")
        docs = near.groupBy("id").agg(F.struct(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(c) for w, c in name.items()]).alias("w"))
        starts = lambda u: _unit([name[w] for w in u])
        where = lambda g, code: reduce(lambda a, u: a | F.exists(starts(u), lambda x: x % 4 == code), g, F.lit(False))
        used = [[where(g, code) for code in range(4)] for g in groups]
        matched = reduce(lambda a, b: a + b, (reduce(lambda a, b: a | b, h).cast("int") for h in used))
        score = reduce(lambda a, b: a + b, (c.cast("double") * _WORTH[k] for h in used for k, c in enumerate(h)))
        bad = reduce(lambda a, u: a | (F.size(starts(u)) > 0), nots, F.lit(False))
        out = docs.where(~bad).select("id", matched.alias("matched"), F.round(score, 6).alias("score")).where("matched > 0")
        out = out.withColumn("match", F.when(F.col("matched") == len(groups), "all").otherwise("any"))
        return out.orderBy(F.col("match") != "all", F.desc("score"), "id").limit(limit)

    index.read = marked.agg(F.count("*").alias("blocks"), F.count_if(F.col("full")).alias("first"), F.count_if(F.col("some")).alias("read")).first().asDict()
    if index.read["first"] == index.read["read"]:
        return answered(marked.where("some"))
    first = written(answered(marked.where("full")), "answer")
    if first.where("match = 'all'").count() >= limit:
        index.read["read"] = index.read["first"]
        return first
    drop(first)
    return answered(marked.where("some"))


def _hits(index: TextIndex, units: list[str], blocks: DataFrame | list[int]) -> DataFrame:
    found = index.postings(units)
    found = found.where(F.col("block").isin(blocks)) if isinstance(blocks, list) else found.join(blocks, "block", "left_semi")
    at = found.select("id", "term", F.explode("positions").alias("x"))
    return at.select("id", F.shiftright("x", 2).alias("pos"), "term", F.element_at(F.array(*[F.lit(w) for w in _WORTH]), F.col("x") % 4 + 1).alias("weight"))


def density(index: TextIndex, units: list[str], limit: int) -> DataFrame:
    """(id, covers, score, best) as ranking.density() gives by reading all texts: the `limit` notes whose covers are worth most.

    A note has at most as many covers around each hit of a unit as there are units, and none is worth more than its best weight; so a
    block is bounded by units x its least greatest term frequency x its greatest weight. The FIRST blocks with the greatest bounds give a
    score to beat; after that only blocks whose bound reaches it are read. Both rounds read postings of the units only.
    """
    units = sorted({u.lower() for u in units})
    heads = index.heads(units).groupBy("block").agg(F.count("*").alias("n"), F.min("most").alias("most"), F.max("worth").alias("worth")).where(F.col("n") == len(units))
    bounds = written(heads.select("block", (F.col("most") * len(units) * F.col("worth")).alias("bound")), "bounds")
    first = [r[0] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    top = written(ranking.densities(_hits(index, units, first), units, limit), "top")
    scores = [r[0] for r in top.select("score").collect()]  # at most limit rows
    beat = min(scores) if len(scores) >= limit else 0.0
    more = ~F.col("block").isin(first) & (F.col("bound") + 1e-6 >= beat)
    rest = bounds.where(more)
    found = bounds.agg(F.count("*").alias("blocks"), F.count_if(more).alias("more")).first()
    index.read = {"blocks": found.blocks, "first": len(first), "read": len(first) + found.more}
    if not found.more:
        return top
    return ranking.ordered(top.unionByName(ranking.densities(_hits(index, units, rest), units, limit)), limit)


def matched_in(index: TextIndex, query: str, rows: DataFrame, parts: dict[str, str]) -> DataFrame:
    """(id, matched_in) for rows(id, match) of keyword(): the parts that match the query by themselves, else the first pair of parts that
    does together, else all parts joined by +. parts names the weights of the index, in order.

    A row of match `all` has to have every group of the query in the parts, one of `any` one of them. One pass over the postings of the
    rows, however many parts and pairs there are.
    """
    groups, _ = parse_query(query)
    words = sorted({w for g in groups for u in g for w in u})
    name = {w: f"w{k}" for k, w in enumerate(words)}
    found = index.postings(words).join(rows.select("id", "match"), "id").groupBy("id", "match")
    docs = found.agg(F.struct(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(c) for w, c in name.items()]).alias("w"))
    codes = {title: CODES[weight] for weight, title in parts.items()}

    def holds(titles: tuple[str, ...]) -> Column:
        wanted = [codes[t] for t in titles]
        inside = lambda x: reduce(lambda a, b: a | b, (x % 4 == c for c in wanted))
        has = [reduce(lambda a, u: a | F.exists(_unit([name[w] for w in u]), inside), g, F.lit(False)) for g in groups]
        return F.when(F.col("match") == "all", reduce(lambda a, b: a & b, has)).otherwise(reduce(lambda a, b: a | b, has))

    single = F.filter(F.array(*[F.when(holds((t,)), F.lit(t)) for t in codes]), lambda x: x.isNotNull())
    pairs = [(a, b) for k, a in enumerate(codes) for b in list(codes)[k + 1 :]]
    together = F.coalesce(*[F.when(holds(p), F.lit("+".join(p))) for p in pairs], F.lit("+".join(codes)))
    return docs.select("id", F.when(F.size(single) > 0, single).otherwise(F.array(together)).alias("matched_in"))


def fragments(index: TextIndex, units: list[str], rows: DataFrame, around: int = 4, least: int = 6, most: int = 18) -> DataFrame:
    """(id, fragments) for rows(id): ranking.fragments() of their hits, from the postings of the units."""
    units = sorted({u.lower() for u in units})
    at = index.postings(units).join(rows.select("id"), "id", "left_semi").select("id", "term", F.explode("positions").alias("x"))
    hits = at.select("id", F.shiftright("x", 2).alias("pos"), "term", F.element_at(F.array(*[F.lit(w) for w in _WORTH]), F.col("x") % 4 + 1).alias("weight"))
    return ranking.fragments(hits, units, around, least, most)
