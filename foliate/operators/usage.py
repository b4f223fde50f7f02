"""Usage analytics over a log of calls: (tool, owner, duration, params as JSON, time)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def param(column: str, key: str) -> Column:
    """A key of a JSON column, as text."""
    return F.get_json_object(column, f"$.{key}")


def guarded_int(text: Column, digits: int = 9) -> Column:
    """Text as a number, null unless it is of 1 to `digits` digits: the guard comes before the cast."""
    return F.when(text.rlike(f"^[0-9]{{1,{digits}}}$"), text.cast("bigint"))


def refusal_weight(suppressed: Column) -> Column:
    """A refusal counts once and for those that were suppressed with it."""
    return F.lit(1).cast("bigint") + F.coalesce(guarded_int(suppressed), F.lit(0))


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, one column for each of `wanted`): exact percentiles with linear interpolation, of values that are not null; keys without any have no row.

    Selection by ranks in two passes: values are counted by coarse buckets that keep their order, which tell in which bucket the two values
    next to each rank are; then only values of these buckets are counted one by one. A hot key is never one task's buffer: what meets for
    it is a count a bucket (of a 64th of a power of two) and the different values of a few buckets. NaN is the greatest value.
    """
    coarse = F.when(F.isnan(F.col(value).cast("double")), F.lit(1 << 20)).otherwise(F.signum(F.col(value).cast("double")) * F.floor(64 * F.log2(1 + F.abs(F.col(value).cast("double"))))).cast("int")
    own = rows.where(F.col(value).isNotNull()).select(*[F.struct(*keys).alias("_key") if keys else F.struct(F.lit(0).alias("_")).alias("_key")], F.col(value).alias("_v"), coarse.alias("_b"))
    upto = Window.partitionBy("_key").orderBy("_b")
    counted = own.groupBy("_key", "_b").agg(F.count("*").alias("_n")).withColumns({"_end": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy("_key"))})
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), up(place(q)).cast("long").alias("rank"), (place(q) - F.floor(place(q)) if up is F.ceil else 1 - (place(q) - F.floor(place(q)))).alias("share"), F.lit(up is F.ceil).alias("upper")) for name, q in wanted.items() for up in (F.floor, F.ceil)])
    asked = counted.select("_key", "_b", (F.col("_end") - F.col("_n")).alias("_start"), F.explode(F.filter(ranks, lambda r: (r["rank"] >= F.col("_end") - F.col("_n")) & (r["rank"] < F.col("_end")))).alias("r"))
    few = asked.select("_key", "_b").distinct()
    values = own.join(few, ["_key", "_b"], "left_semi").groupBy("_key", "_b", "_v").agg(F.count("*").alias("_n"))
    values = values.withColumn("_end", F.sum("_n").over(Window.partitionBy("_key", "_b").orderBy("_v")))
    met = asked.join(values, ["_key", "_b"]).where((F.col("r.rank") - F.col("_start") >= F.col("_end") - F.col("_n")) & (F.col("r.rank") - F.col("_start") < F.col("_end")))
    # both values of a rank that is a whole number are one: its lower share is 1 and its upper 0
    parts = [F.sum(F.when(F.col("r.name") == name, F.when(F.col("r.share") > 0, F.col("_v") * F.col("r.share")).otherwise(0.0))).alias(name) for name in wanted]
    return met.groupBy("_key").agg(*parts).select(*[F.col(f"_key.{k}").alias(k) for k in keys], *wanted)


def _with_percentiles(out: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """out with the percentiles of its keys, null where there are none; null keys are keys."""
    renamed = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return out.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


def tool_aggregates(log: DataFrame, tool: str, duration: str, refused: Column, suppressed: Column, size: Column) -> DataFrame:
    """Per tool: executed calls, weighted refusals, exact percentiles of durations, mean and greatest size. Refused calls have no durations."""
    ran = log.select(F.col(tool).alias("tool"), F.when(~refused, F.col(duration)).alias("duration"))
    out = log.groupBy(F.col(tool).alias("tool")).agg(
        F.count_if(~refused).alias("executed"),
        F.coalesce(F.sum(F.when(refused, refusal_weight(suppressed))), F.lit(0)).alias("refused"),
        F.avg(F.when(~refused, size)).alias("mean_size"),
        F.max(F.when(~refused, size)).alias("max_size"),
    )
    return _with_percentiles(out, percentiles(ran, ["tool"], "duration", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), ["tool"])


def phase_breakdown(log: DataFrame, tool: str, phase: Column) -> DataFrame:
    """Calls that report a phase: count, mean and 95th percentile per tool. Calls without it don't count."""
    rows = log.select(F.col(tool).alias("tool"), phase.alias("phase")).where("phase IS NOT NULL")
    return _with_percentiles(rows.groupBy("tool").agg(F.count("*").alias("n"), F.avg("phase").alias("mean")), percentiles(rows, ["tool"], "phase", {"p95": 0.95}), ["tool"])


def tool_table(log: DataFrame, cls: Column, tool: str, duration: str) -> DataFrame:
    """Counts and 95th percentiles by (class, tool), by class and in all, as grouping sets of one scan."""
    rows = log.select(cls.alias("cls"), F.col(tool).alias("tool"), F.col(duration).alias("duration"))
    none = F.lit(None).cast("string")
    level = lambda c, t, g, h: F.struct(c.alias("cls"), t.alias("tool"), F.lit(g).alias("g_cls"), F.lit(h).alias("g_tool"))
    sets = F.explode(F.array(level(F.col("cls"), F.col("tool"), 0, 0), level(F.col("cls"), none, 0, 1), level(none, none, 1, 1)))
    each = rows.select(sets.alias("k"), "duration").select("k.*", "duration")
    keys = ["cls", "tool", "g_cls", "g_tool"]
    counts = each.groupBy(*keys).agg(F.count("*").alias("n"))
    return _with_percentiles(counts, percentiles(each, keys, "duration", {"p95": 0.95}), keys).select(*keys, "n", "p95")


def counter_totals(log: DataFrame, metric: str, value: Column) -> DataFrame:
    """Counters add up, gauges keep their greatest value."""
    return log.groupBy(F.col(metric).alias("metric")).agg(F.count("*").alias("total"), F.max(value).alias("peak"))


def chart_series(log: DataFrame, time: str, unit: str = "hour") -> DataFrame:
    """Calls per UTC hour or day; empty buckets are not filled."""
    return log.groupBy(F.date_trunc(unit, time).alias("bucket")).agg(F.count("*").alias("n"))


def actor_totals(log: DataFrame, actor: str, time: str) -> DataFrame:
    """Calls and last time of each actor."""
    return log.groupBy(F.col(actor).alias("actor")).agg(F.count("*").alias("n"), F.max(time).alias("last_seen"))


def grouped_queries(log: DataFrame, query: Column, results: Column) -> DataFrame:
    """Per query: calls, calls with a readable number of results, mean of those (null without any) and calls without results."""
    rows = log.select(query.alias("query"), results.alias("results")).where("query IS NOT NULL")
    return rows.groupBy("query").agg(F.count("*").alias("n"), F.count("results").alias("readable"), F.avg("results").alias("mean_results"), F.count_if(F.col("results") == 0).alias("zero"))


def slowest(log: DataFrame, duration: str, key: str, n: int = 50) -> DataFrame:
    """The n slowest calls; ties by key."""
    return log.where(F.col(duration).isNotNull()).orderBy(F.desc(duration), key).limit(n)


def admitted(log: DataFrame, key: str, time: str, order: str, limit: int) -> DataFrame:
    """A daily quota replayed: the first `limit` calls of each key and UTC day are admitted."""
    day = F.to_date(time)
    rank = F.row_number().over(Window.partitionBy(key, day).orderBy(time, order))
    return log.withColumns({"day": day, "rank": rank}).withColumn("admitted", F.col("rank") <= limit)


def consumed(log: DataFrame, key: str, time: str, day: str) -> DataFrame:
    """Calls of each key on a UTC day."""
    return log.where(F.to_date(time) == F.lit(day).cast("date")).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def configurations(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Configurations present in two sources with their counts added: each side is grouped before they meet."""
    both = first.groupBy(*keys).agg(F.count("*").alias("n")).unionByName(second.groupBy(*keys).agg(F.count("*").alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def with_dimensions(log: DataFrame, key: str, dimension: DataFrame, dim_key: str, name: str) -> DataFrame:
    """Rows with a dimension's name, and owner_missing where a key has no dimension row."""
    d = dimension.select(F.col(dim_key).alias("_k"), F.col(name).alias("owner"))
    return log.join(d, F.col(key) == F.col("_k"), "left").withColumn("owner_missing", F.col(key).isNotNull() & F.col("_k").isNull()).drop("_k")


def dashboard(notes: DataFrame, text: str, pending: Column, truncated: Column, modified: str | None = None) -> DataFrame:
    """Counts of a collection in one pass."""
    return notes.agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(truncated).alias("truncated"), F.count_distinct(text).alias("distinct_texts"))


def readiness(stats: DataFrame, met: int, of: int) -> DataFrame:
    """Whether at least met/of of a row's n calls were ok, by whole-number products: ratios are never compared as floats."""
    return stats.withColumn("ready", (F.col("ok") * of >= F.col("n") * met) & (F.col("n") > 0))
