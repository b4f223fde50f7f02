"""Keyword search, rank fusion, rerank allocation and retrieval metrics."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of a text index.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.02}


def terms(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parse_query(query: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(groups, negated units): a unit is a word, or the words of a quoted phrase; units joined by OR are a group, others one each; a leading - negates."""
    groups: list[list[list[str]]] = []
    nots, joining = [], False
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word == "OR" and not sign:
            joining = bool(groups)
            continue
        unit = re.findall(r"[^\W_]+", (phrase or word).lower())  # letters and digits, as terms() cuts texts
        if unit and sign:
            nots.append(unit)
        elif unit and joining:
            groups[-1].append(unit)
        elif unit:
            groups.append([unit])
        joining = False
    return groups, nots


def _has(words: str, unit: list[str]) -> Column:
    """Words side by side in a text whose words stand between single spaces."""
    return F.contains(F.col(words), F.lit(" " + " ".join(unit) + " "))


def keyword(notes: DataFrame, id_col: str, query: str, limit: int, title: str | None = None, body: str = "text") -> DataFrame:
    """(id, match, matched, score): rows with every unit first, then rows with any of them, up to `limit` rows.

    Of units joined by OR one is enough. The score adds the weight of each unit's part: A in the title, D in the body. Within a block by score, then id; a negated unit
    excludes. One scan: the blocks are a sort key, and only ids and scores are sorted.
    """
    groups, nots = parse_query(query)
    spaced = lambda c: F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    rows = notes.select(F.col(id_col).alias("id"), spaced(F.col(title) if title else F.lit("")).alias("a"), spaced(F.col(body)).alias("d"))
    either = lambda part, group: reduce(lambda x, u: x | _has(part, u), group, F.lit(False))
    hit = [(either("a", g), either("d", g)) for g in groups]
    matched = sum(((a | d).cast("int") for a, d in hit), F.lit(0))
    score = sum((a.cast("double") * WEIGHTS["A"] + d.cast("double") * WEIGHTS["D"] for a, d in hit), F.lit(0.0))
    bad = either("a", nots) | either("d", nots)
    out = rows.where(~bad).select("id", matched.alias("matched"), F.round(score, 6).alias("score")).where("matched > 0")
    out = out.withColumn("match", F.when(F.col("matched") == len(groups), "all").otherwise("any"))
    return out.orderBy(F.col("match") != "all", F.desc("score"), "id").limit(limit)


def hybrid(notes: DataFrame, vectors: DataFrame, allowed: Column, id_col: str, text_col: str, vec_col: str, query: str, like: list[float] | None, limit: int, depth: int = 100, threshold: float = 0.5) -> DataFrame:
    """(id, score, place, keyword_rank, vector_rank, similarity, matched_in, confidence) of the `limit` best notes for a text and a vector.

    notes(id, text, ...) and vectors(id, vector) are first held to one filter over notes; each arm gives its `depth` best, the keyword arm in
    the order of keyword(), the other by the best cosine of a note's vectors, so a note has one place however many it has. Reciprocal rank
    fusion orders what either has. confidence is that of the whole answer. like None: no vector is known, keywords alone answer.
    """
    rows = notes.where(allowed)
    words = keyword(rows, id_col, query, depth, body=text_col)
    words = words.withColumn("keyword_rank", F.row_number().over(Window.orderBy(F.col("match") != "all", F.desc("score"), "id")))  # depth rows
    target = F.array(*[F.lit(float(x)) for x in like or [0.0]])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    near = vectors.join(rows.select(id_col), id_col).select(F.col(id_col).alias("id"), F.round(dot(F.col(vec_col), target) / F.sqrt(dot(F.col(vec_col), F.col(vec_col).cast("array<double>"))) / F.sqrt(dot(target, target)), 9).alias("similarity"))
    near = near.where(F.col("similarity").isNotNull() & F.lit(like is not None)).groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(depth)
    near = near.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))  # depth rows
    both = words.select("id", "keyword_rank", (F.col("match") == "all").alias("all")).join(near, "id", "full_outer")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(60.0) + F.col(rank)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("keyword_rank") + part("vector_rank"), 12))
    every = Window.partitionBy(F.lit(1))
    both = both.withColumn("confidence", confidence(F.max("all").over(every), F.max("similarity").over(every), threshold))
    where = F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both")
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.least("keyword_rank", "vector_rank"), "id"))
    return both.select("id", "score", place.alias("place"), "keyword_rank", "vector_rank", "similarity", where.alias("matched_in"), "confidence").where(F.col("place") <= limit)


def index_of(notes: DataFrame, id_col: str, text: str) -> DataFrame:
    """Inverted index: (term, id, tf, first position) for every term of every text."""
    rows = notes.select(F.col(id_col).alias("id"), F.posexplode(terms(F.col(text))).alias("pos", "term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


def term_statistics(notes: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, documents, occurrences): words of a note are counted within the note, so each moves once, and summed before they move."""
    words = notes.select(F.array_sort(terms(F.col(text))).alias("w"))
    # in sorted words a run of equal ones begins where a word differs from the one before it
    begins = F.filter(F.sequence(F.lit(0), F.size("w")), lambda k: (k == F.size("w")) | (k == 0) | (F.get("w", k) != F.get("w", k - 1)))
    runs = words.where(F.size("w") > 0).select("w", begins.alias("b"))
    each = runs.select(F.explode(F.transform(F.slice("b", 1, F.size("b") - 1), lambda k, i: F.struct(F.get("w", k).alias("term"), (F.get("b", i + 1) - k).alias("n")))).alias("x"))
    return each.groupBy("x.term").agg(F.count("*").alias("documents"), F.sum("x.n").alias("occurrences"))


def fused(arms: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (keys, rank): score, best rank of an arm and place; ties by best rank, then keys."""
    both = arms[0].select(*keys, "rank")
    for arm in arms[1:]:
        both = both.union(arm.select(*keys, "rank"))
    out = both.groupBy(*keys).agg(F.sum(F.lit(1.0).cast("double") / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min("rank").alias("best"))
    out = out.withColumn("score", F.round("score", 12))
    w = Window.partitionBy(*keys[:-1]).orderBy(F.desc("score"), "best", keys[-1])
    return out.withColumn("place", F.row_number().over(w))


def confidence(all_matched: Column, similarity: Column, threshold: float) -> Column:
    """'low' where no row has all terms and the best similarity is missing or under a positive threshold."""
    low = F.lit(threshold > 0) & ~F.coalesce(all_matched, F.lit(False)) & (similarity.isNull() | (similarity < threshold))
    return F.when(low, "low").otherwise("ok")


def allocated(candidates: DataFrame, query: str, note: str, note_rank: str, distance: str, chunk: str, budget: int, per_note: int = 4) -> DataFrame:
    """Documents for reranking: the nearest chunk of each note first, then other chunks by distance while the budget lasts, at most `per_note` of a note."""
    inside = F.row_number().over(Window.partitionBy(query, note).orderBy(distance, chunk))
    rows = candidates.withColumn("_i", inside).where(F.col("_i") <= per_note).withColumn("primary", F.col("_i") == 1)
    turn = F.row_number().over(Window.partitionBy(query).orderBy(F.col("_i") > 1, F.when(F.col("_i") == 1, F.col(note_rank)), distance, note, chunk))
    return rows.withColumn("slot", turn).where(F.col("slot") <= budget).drop("_i")


def reranked(scores: DataFrame, query: str, note: str, place: str, score: str) -> DataFrame:
    """Notes by their greatest document score; ties keep the place they had."""
    best = scores.groupBy(query, note).agg(F.max(score).alias("score"), F.min(place).alias("was"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "was")))


def retrieval_metrics(run: DataFrame, judged: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Per query of judged(query, item): recall@k, reciprocal rank, nDCG@k of run(query, item, rank). Queries that found nothing score 0."""
    hits = run.where(F.col("rank") <= k).join(judged.select(query, item), [query, item], "left_semi")
    per = hits.groupBy(query).agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    need = judged.groupBy(query).agg(F.count("*").alias("r"))
    ideal = F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1)])
    out = need.join(per, query, "left")
    return out.select(query, (F.coalesce("h", F.lit(0)) / F.col("r")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / F.element_at(ideal, F.least(F.col("r"), F.lit(k)).cast("int")), F.lit(0.0)).alias("ndcg"))


def classified(query: Column) -> Column:
    """'identifier' for queries of codes, paths and symbols, 'prose' for others."""
    return F.when(query.rlike(r"[0-9_/\\.:#]|[a-z][A-Z]"), "identifier").otherwise("prose")


def overlap(left: Column, right: Column) -> tuple[Column, Column]:
    """(containment, Jaccard) of two term sets."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), both / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
