"""Change feeds and time: sequences, suppression, retention, intervals, coverage, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequenced(events: DataFrame, scope: str, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """Consecutive numbers per scope, after the last number that the scope has in last(scope, last_seq)."""
    seq = F.row_number().over(Window.partitionBy(scope).orderBy(*order)).cast("bigint")
    if last is None:
        return events.withColumn("seq", seq)
    return events.join(last, scope, "left").withColumn("seq", seq + F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def latest_at(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest event of each key, with all its columns."""
    rest = [c for c in events.columns if c not in keys]
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return newest.select(*keys, "e.*")


def suppressed(candidates: DataFrame, events: DataFrame, path: str, kind: str, order: str, time: str) -> DataFrame:
    """Candidates with `suppressed`: the newest event at the path says the same and isn't older."""
    last = events.groupBy(F.col(path).alias("_p")).agg(F.max_by(F.struct(F.col(kind).alias("k"), F.col(time).alias("t")), order).alias("_l"))
    out = candidates.join(last, F.col(path) == F.col("_p"), "left")
    return out.withColumn("suppressed", F.coalesce((F.col("_l.k") == F.col(kind)) & (F.col("_l.t") >= F.col(time)), F.lit(False))).drop("_p", "_l")


def retained(events: DataFrame, scope: str, seq: str, time: str, cutoff: str, most: int) -> DataFrame:
    """What stays: not of the expired prefix, and of the newest `most`; the newest event of a scope always stays.

    The prefix ends before the first event that isn't older than the cutoff, so late events in the middle stay.
    """
    by = Window.partitionBy(scope)
    first_live = F.min(F.when(F.col(time) >= F.lit(cutoff).cast("timestamp"), F.col(seq))).over(by)
    newest = F.max(seq).over(by)
    rank = F.row_number().over(by.orderBy(F.desc(seq)))
    kept = ((F.col(seq) >= F.coalesce(first_live, newest)) & (rank <= most)) | (F.col(seq) == newest)
    return events.withColumn("_keep", kept).where("_keep").drop("_keep")


def watermarks(events: DataFrame, kept: DataFrame, scope: str, seq: str) -> DataFrame:
    """(scope, pruned_through): the number before the least that is kept."""
    return kept.groupBy(scope).agg((F.min(seq) - 1).alias("pruned_through"))


def changes_since(events: DataFrame, seq: str, since: int, kinds: list[str], kind: str, n: int) -> DataFrame:
    """Events after a cursor, oldest first, n of them and one more."""
    return events.where((F.col(seq) > since) & F.col(kind).isin(kinds)).orderBy(seq).limit(n + 1)


def chained(versions: DataFrame, key: str, time: str, order: str, value: str, gone: str | None = None) -> DataFrame:
    """Versions to half-open validity intervals: repeats collapse, times never run backwards, an interval ends where the next begins.

    gone: a value that ends an interval and gives none. Intervals without length are dropped.
    """
    w = Window.partitionBy(key).orderBy(time, order)
    change = versions.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col(value)))
    clamped = change.withColumn("valid_from", F.max(time).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = clamped.withColumn("valid_to", F.lead("valid_from").over(w)).drop("_p", "_n")
    if gone is not None:
        out = out.where(~F.col(value).eqNullSafe(F.lit(gone)))
    return out.where("valid_to IS NULL OR valid_from < valid_to")


def merged(runs: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Covered intervals per key: runs that touch or overlap are one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min(start).alias("covered_from"), F.max(end).alias("covered_to")).drop("_g")


def gaps(covered: DataFrame, key: str) -> DataFrame:
    """What lies between the covered intervals of a key."""
    w = Window.partitionBy(key).orderBy("covered_from")
    return covered.select(key, F.col("covered_to").alias("gap_from"), F.lead("covered_from").over(w).alias("gap_to")).where("gap_to IS NOT NULL")


def attributed(reads: DataFrame, searches: DataFrame, keys: list[str], time: str, window: str, value: str) -> DataFrame:
    """As-of join: each read gets the newest search of its keys strictly before it, within the window.

    One pass over both in time order, by a range frame; no product of reads and searches.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = F.expr(f"CAST(unix_micros(timestamp_ltz'1970-01-01 00:00:00' + interval {window}) AS BIGINT)")
    both = reads.select(*keys, time, F.struct(*reads.columns).alias("r"), F.lit(None).cast(searches.schema[value].dataType).alias("s")).unionByName(
        searches.select(*keys, time, F.lit(None).cast(reads.select(F.struct(*reads.columns).alias("r")).schema["r"].dataType).alias("r"), F.col(value).alias("s"))
    )
    both = both.withColumns({"_t": micros, "_span": span})
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("s").isNotNull(), F.struct("_t", "s"))).over(w)
    found = both.withColumn("_l", last).where("r IS NOT NULL")
    return found.select("r.*", F.when(F.col("_t") - F.col("_l._t") <= F.col("_span"), F.col("_l.s")).alias("attributed"))


def snapshot_diff(before: DataFrame, after: DataFrame, path: str, content: str) -> DataFrame:
    """Events of a pass: moves (one old and one new path with the same content), then deletes, creates and changes."""
    b = before.select(F.col(path).alias("old"), F.col(content).alias("old_hash"))
    a = after.select(F.col(path).alias("new"), F.col(content).alias("new_hash"))
    joined = b.join(a, F.col("old") == F.col("new"), "full_outer")
    lost, found = joined.where("new IS NULL").select("old", "old_hash"), joined.where("old IS NULL").select("new", "new_hash")
    one = lambda df, h, p: df.groupBy(h).agg(F.count("*").alias("n"), F.min(p).alias(p)).where("n = 1").drop("n")
    moves = one(lost, "old_hash", "old").join(one(found, "new_hash", "new"), F.col("old_hash") == F.col("new_hash")).select("old", "new")
    kinds = [
        moves.select(F.lit("move").alias("kind"), F.col("new").alias("path"), F.col("old").alias("from_path")),
        lost.join(moves, "old", "left_anti").select(F.lit("delete"), "old", F.lit(None).cast("string")),
        found.join(moves, "new", "left_anti").select(F.lit("create"), "new", F.lit(None).cast("string")),
        joined.where("old IS NOT NULL AND new IS NOT NULL AND NOT (old_hash <=> new_hash)").select(F.lit("modify"), "new", F.lit(None).cast("string")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out


def uncovered(runs: DataFrame, key: str, begin: str, end: str, start: object, stop: object, matching: Column, lossy: Column, clean: Column) -> DataFrame:
    """(key, uncovered_from, uncovered_to): what of [start, stop) the runs of a key don't cover, as separate intervals in order.

    A matching run that isn't lossy covers from its begin to its end; any other poisons that span. From a run's end to the next begin of
    another run a clean one covers and an unclean one poisons, without a next run for ever. Poison wins over cover. A run of no length
    looks only for runs behind it in order. Keys without runs aren't there. Sorting is within a key, by windows; nothing is paired.
    """
    own = Window.partitionBy("_k")
    kind = runs.schema[begin].dataType
    low, high = F.lit(start).cast(kind), F.lit(stop).cast(kind)
    r = runs.select(F.col(key).alias("_k"), F.col(begin).alias("b"), F.col(end).alias("e"), F.coalesce(matching & ~lossy, F.lit(False)).alias("good"), F.coalesce(clean, F.lit(False)).alias("clean"))
    turn = F.when(F.col("b") < F.col("e"), 0).otherwise(2)
    points = r.select("_k", F.explode(F.array(F.struct(F.col("b").alias("t"), F.lit(1).alias("turn"), F.col("b").alias("begins")), F.struct(F.col("e").alias("t"), turn.alias("turn"), F.lit(None).cast(kind).alias("begins")))).alias("p"), "b", "e", "good", "clean")
    behind = own.orderBy("p.t", "p.turn", "b", "e").rowsBetween(1, Window.unboundedFollowing)
    ended = points.withColumn("next", F.min("p.begins").over(behind)).where("p.begins IS NULL")
    span = lambda a, b, covers: F.struct(a.alias("a"), b.alias("b"), covers.alias("covers"))
    rest = F.when(~F.col("clean"), span(F.col("e"), F.coalesce("next", high), F.lit(False))).when(F.col("next").isNotNull(), span(F.col("e"), F.col("next"), F.lit(True)))
    spans = ended.select("_k", F.explode(F.array(span(F.col("b"), F.col("e"), F.col("good")), rest)).alias("s")).where("s IS NOT NULL")
    cut = spans.select("_k", F.greatest("s.a", low).alias("a"), F.least("s.b", high).alias("b"), F.col("s.covers").alias("covers")).where("a < b")
    all_ = cut.unionByName(r.select("_k").distinct().select("_k", low.alias("a"), high.alias("b"), F.lit(None).cast("boolean").alias("covers")).where("a < b"))
    sign = lambda t, n: F.struct(t.alias("t"), F.when(F.col("covers"), n).otherwise(0).alias("cover"), F.when(~F.col("covers"), n).otherwise(0).alias("poison"))
    moves = all_.select("_k", F.explode(F.array(sign(F.col("a"), 1), sign(F.col("b"), -1))).alias("m")).groupBy("_k", F.col("m.t").alias("t")).agg(F.sum("m.cover").alias("cover"), F.sum("m.poison").alias("poison"))
    upto = own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    bad = (F.sum("cover").over(upto) <= 0) | (F.sum("poison").over(upto) > 0)
    pieces = moves.withColumns({"bad": bad, "until": F.lead("t").over(own.orderBy("t"))}).where("bad AND until IS NOT NULL")
    return merged(pieces.select(F.col("_k").alias(key), "t", "until"), key, "t", "until").select(key, F.col("covered_from").alias("uncovered_from"), F.col("covered_to").alias("uncovered_to"))
