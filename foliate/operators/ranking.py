"""Cover density ranks of keyword hits and highlighted excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words of a text as they are written, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hits(part: Column, first: Column, weight: float, units: list[str]) -> Column:
    """(pos, term, weight) of every word of a part that is one of the units; positions count on from `first`."""
    each = F.transform(part, lambda w, i: F.struct((i + first).alias("pos"), F.lower(w).alias("term"), F.lit(weight).alias("weight")))
    return F.filter(each, lambda x: x["term"].isin(units))


def hits_of(notes: DataFrame, id_col: str, units: list[str], parts: dict[str, float]) -> DataFrame:
    """(id, pos, term, weight) of every word that is one of the units. parts: weights of text columns, whose words stand one part after the other."""
    found, first = [], F.lit(0)
    for column, weight in parts.items():
        part = words(F.col(column))
        found.append(_hits(part, first, weight, units))
        first = first + F.size(part)
    return notes.select(F.col(id_col).alias("id"), F.explode(F.concat(*found)).alias("h")).select("id", "h.*")


def covers(notes: DataFrame, id_col: str, units: list[str], parts: dict[str, float]) -> DataFrame:
    """(id, begin, end, value): the shortest spans of words that hold every unit, none inside another.

    id_col is a key. Only the hits leave the scan. A note without all units has no rows, null texts have no words.
    """
    units = sorted({u.lower() for u in units})
    return spans(hits_of(notes, id_col, units, parts), units)


def spans(hits: DataFrame, units: list[str]) -> DataFrame:
    """covers() of hits(id, pos, term, weight), wherever they come from.

    A span is worth the harmonic mean of its hits' weights, divided by one more than its words that are no hits. Windows order the hits of
    one note.
    """
    w = Window.partitionBy("id").orderBy("pos")
    rows = hits.withColumns({"n": F.row_number().over(w), "sum": F.sum(1 / F.col("weight")).over(w)})
    here = F.struct("n", "pos", (F.col("sum") - 1 / F.col("weight")).alias("before"))
    latest = {f"u{k}": F.max(F.when(F.col("term") == u, here)).over(w) for k, u in enumerate(units)}
    rows = rows.withColumns(latest).dropna(subset=list(latest)).withColumn("from", F.array_min(F.array(*latest)))
    rows = rows.withColumn("last", F.lag("from.n").over(w)).where("last IS NULL OR from.n > last")
    value = (F.col("n") - F.col("from.n") + 1) / (F.col("sum") - F.col("from.before")) / (1 + F.col("pos") - F.col("from.pos") - F.col("n") + F.col("from.n"))
    return rows.select("id", F.col("from.pos").alias("begin"), F.col("pos").alias("end"), value.alias("value"))


def ordered(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows by score, then id."""
    return found.orderBy(F.desc("score"), "id").limit(limit)


def densities(hits: DataFrame, units: list[str], limit: int) -> DataFrame:
    """density() of hits(id, pos, term, weight)."""
    best = F.max_by(F.struct("begin", "end"), F.struct(F.round("value", 9), -F.col("begin")))
    out = spans(hits, units).groupBy("id").agg(F.count("*").alias("covers"), F.round(F.sum("value"), 6).alias("score"), best.alias("best"))
    return ordered(out, limit)


def density(notes: DataFrame, id_col: str, units: list[str], parts: dict[str, float], limit: int) -> DataFrame:
    """(id, covers, score, best) of the `limit` notes whose covers are worth most together, then by id; best(begin, end) is the worthiest cover.

    Reads every text; textindex.density() gives the same rows from postings.
    """
    units = sorted({u.lower() for u in units})
    return densities(hits_of(notes, id_col, units, parts), units, limit)


def fragments(hits: DataFrame, units: list[str], around: int = 4, least: int = 6, most: int = 18) -> DataFrame:
    """(id, fragments) of hits(id, pos, term, weight): one or two stretches (first, words) in the order of the text.

    The first choice is the stretch around the worthiest cover, the second that around the worthiest cover whose stretch doesn't meet it;
    of equal ones the earlier. A stretch has `around` words on either side of its cover, `least` to `most` words in all.
    """
    first = F.greatest(F.col("begin") - around, F.lit(0))
    length = F.least(F.greatest(F.col("end") - F.col("begin") + 1 + 2 * around, F.lit(least)), F.lit(most))
    rows = spans(hits, units).select("id", F.struct(first.cast("int").alias("first"), length.cast("int").alias("words")).alias("at"), F.struct(F.round("value", 9), -F.col("begin")).alias("worth"))
    best = rows.groupBy("id").agg(F.max_by("at", "worth").alias("one"))
    apart = (F.col("at.first") >= F.col("one.first") + F.col("one.words")) | (F.col("one.first") >= F.col("at.first") + F.col("at.words"))
    both = rows.join(best, "id").groupBy("id", "one").agg(F.max_by(F.when(apart, F.col("at")), F.when(apart, F.col("worth"))).alias("two"))
    return both.select("id", F.array_sort(F.filter(F.array("one", "two"), lambda x: x.isNotNull())).alias("fragments"))


def excerpts(notes: DataFrame, id_col: str, found: DataFrame, units: list[str], parts: list[str]) -> DataFrame:
    """(id, excerpt) for found(id, fragments): the words of each stretch with units in <b></b>, stretches parted by an ellipsis."""
    units = [u.lower() for u in units]
    rows = notes.select(F.col(id_col).alias("id"), *parts).join(F.broadcast(found), "id").withColumn("_w", F.concat(*[words(F.col(p)) for p in parts]))
    marked = lambda w: F.when(F.lower(w).isin(units), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)
    cut = F.transform("fragments", lambda x: F.array_join(F.transform(F.slice("_w", x["first"] + 1, x["words"]), marked), " "))
    return rows.select("id", F.array_join(cut, " … ").alias("excerpt"))


def snippets(notes: DataFrame, id_col: str, ranked: DataFrame, units: list[str], parts: list[str], around: int = 4, least: int = 6, most: int = 18) -> DataFrame:
    """(id, score, snippet) for the rows of density(): the words around the best cover, `least` to `most` of them where there are so many, units in <b></b>.

    ranked has a fixed limit, so it is what is broadcast; the notes are read once more for their words.
    """
    units = [u.lower() for u in units]
    begin = F.greatest(F.col("best.begin") - around, F.lit(0))
    length = F.least(F.greatest(F.col("best.end") - F.col("best.begin") + 1 + 2 * around, F.lit(least)), F.lit(most))
    cut = F.slice(F.concat(*[words(F.col(p)) for p in parts]), begin + 1, length)
    marked = F.transform(cut, lambda w: F.when(F.lower(w).isin(units), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    rows = notes.select(F.col(id_col).alias("id"), *parts).join(F.broadcast(ranked), "id")
    return rows.select("id", "score", F.array_join(marked, " ").alias("snippet"))
