"""Comparing arms of an evaluation: paired differences and bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of 32 bits below which a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def paired(values: DataFrame, arm: str, query: str, value: str, baseline: str) -> DataFrame:
    """(arm, query, delta): every other arm's value less the baseline's, for queries that both have."""
    base = values.where(F.col(arm) == baseline).select(query, F.col(value).alias("_base"))
    return values.where(F.col(arm) != baseline).join(base, query).select(arm, query, (F.col(value) - F.col("_base")).alias("delta"))


def _draws(seed: int, query: str) -> Column:
    """How often a resample `r` holds a query: Poisson of mean 1, by a hash of seed, resample and query alone."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("r"), F.col(query))), 1, 8), 16, 10).cast("long")
    return sum(((u >= t).cast("int") for t in POISSON), F.lit(0))


def interval(deltas: DataFrame, by: list[str], query: str, delta: str, resamples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by, n, mean, low, high): the mean of each group and the percentile bootstrap interval of it.

    Every query draws its own number for each resample from a hash, so resamples are summed where the rows are, no group meets in
    one task, and the result depends on neither order nor partitions. Resamples that draw nothing are left out, and so
    are null deltas. A group has a row if it has a delta; low and high are null where no resample drew any.
    """
    rows = deltas.where(F.col(delta).isNotNull()).select(*by, query, F.col(delta).alias("_d"), F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))).alias("r"))
    rows = rows.withColumn("_w", F.when(F.col("r") < 0, 1).otherwise(_draws(seed, query)))
    sums = rows.groupBy(*by, "r").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_d")).alias("s")).where("n > 0")
    mean, own = F.col("s") / F.col("n"), F.col("r") < 0
    edge = [(1 - level) / 2, (1 + level) / 2]
    out = sums.groupBy(*by).agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, mean)).alias("mean"), F.percentile(F.when(~own, mean), edge).alias("_e"))
    return out.select(*by, "n", "mean", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))


def novelty(run: DataFrame, baseline: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, novelty): the share of a run's k first items that the baseline's k first don't have, from (query, item, rank)."""
    top = lambda df: df.where(F.col("rank") <= k).select(query, item).distinct()
    both = top(run).join(top(baseline).withColumn("_old", F.lit(1)), [query, item], "left")
    return both.groupBy(query).agg((F.count_if(F.col("_old").isNull()) / F.count("*")).alias("novelty"))


def thresholds(answers: DataFrame, value: str, right: str, at: list[float]) -> DataFrame:
    """(threshold, answered, right): rows of which the value reaches each threshold, and those of them that are right.

    Rows are summed by the number of thresholds that they reach before anything moves: as many sums as thresholds.
    """
    reached = sum((F.coalesce(F.col(value) >= t, F.lit(False)).cast("int") for t in sorted(at)), F.lit(0))
    sums = answers.groupBy(reached.alias("_n")).agg(F.count("*").alias("answered"), F.count_if(F.col(right)).alias("right"))
    steps = sums.select(F.explode(F.expr("CASE WHEN _n > 0 THEN sequence(1, _n) ELSE array() END")).alias("_k"), "answered", "right").groupBy("_k").agg(F.sum("answered").alias("answered"), F.sum("right").alias("right"))
    return steps.select(F.element_at(F.array(*[F.lit(float(t)) for t in sorted(at)]), F.col("_k")).alias("threshold"), "answered", "right")


def verdict(deltas: DataFrame, by: list[str], delta: str, least: float = 0.0, worst: float = -0.5) -> DataFrame:
    """(by, n, mean, losses, verdict): 'pass' where the mean difference reaches `least` and no query loses more than `worst`, else 'fail'; 'empty' without differences."""
    d = F.col(delta)
    out = deltas.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.count_if(d < worst).alias("losses"))
    return out.withColumn("verdict", F.when(F.col("n") == 0, "empty").when((F.col("mean") >= least) & (F.col("losses") == 0), "pass").otherwise("fail"))
