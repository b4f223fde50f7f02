"""Incremental work: what is left to do, budgets, reuse of earlier results, and merging changes into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(notes: DataFrame, done: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Rows of notes that done(id, hash) doesn't have with the same hash: new ones and changed ones. A null hash is done only as null."""
    old = done.select(F.col(id_col).alias("_id"), F.col(hash_col).alias("_hash"))
    return notes.join(old, (F.col(id_col) == F.col("_id")) & F.col(hash_col).eqNullSafe(F.col("_hash")), "left_anti")


def within_budget(rows: DataFrame, scope: str, order: str, cost: str, budget: int, width: int = 1000) -> DataFrame:
    """Rows of each scope, by order, that begin before its budget of cost is used up. order: unique numbers in a scope.

    Costs are summed by ranges of `width` numbers before anything is ordered. Ranges that end inside the budget are taken whole, and only
    rows of the range where it runs out are put in order one by one, so no task gets all rows of a large scope.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(F.col(scope).alias("_scope"), F.col("_range").alias("_at")).agg(F.sum(cost).alias("_cost"))
    before = F.sum("_cost").over(Window.partitionBy("_scope").orderBy("_at")) - F.col("_cost")
    open_ = sums.withColumn("_before", before).where(F.col("_before") < budget)
    met = ranged.join(open_, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_range") == F.col("_at")))
    whole = met.where(F.col("_before") + F.col("_cost") <= budget)
    inside = Window.partitionBy("_scope", "_range").orderBy(order)
    edge = met.where(F.col("_before") + F.col("_cost") > budget).withColumn("_used", F.col("_before") + F.sum(cost).over(inside) - F.col(cost)).where(F.col("_used") < budget)
    return whole.select(*rows.columns).union(edge.select(*rows.columns))


def reused(wanted: DataFrame, done: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(id, source): for rows of wanted whose hash a row of done has, the least id of done with it. Hashes are unique before they are joined."""
    first = done.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("source"))
    return wanted.join(first, hash_col).select(id_col, "source")


def upserted(target: DataFrame, changes: DataFrame, keys: list[str], deleted: Column | None = None) -> DataFrame:
    """target after changes(keys, other columns of target): rows with a key of changes are replaced, new ones added, those that `deleted` marks go."""
    kept = target.join(changes.select(*keys), keys, "left_anti")
    new = changes.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else changes
    return kept.select(*target.columns).unionByName(new.select(*target.columns))


def retrieved(log: DataFrame, paths: str, owner: str) -> DataFrame:
    """(owner, path, times) from a log whose column `paths` is a JSON array of paths; what is no array gives nothing, and a path counts once a row."""
    items = F.array_distinct(F.from_json(F.col(paths), "array<string>"))
    one = log.select(F.col(owner).alias("owner"), F.explode(items).alias("path")).where("path IS NOT NULL")
    return one.groupBy("owner", "path").agg(F.count("*").alias("times"))


def most_retrieved(log: DataFrame, notes: DataFrame, paths: str, owner: str, path: str, n: int) -> DataFrame:
    """(owner, path, times, exists): the n paths that a log names oftenest; exists: a note of the same owner, null being one of its own, has the path."""
    known = notes.select(F.col(owner).alias("_owner"), F.col(path).alias("_path")).distinct().withColumn("_is", F.lit(True))
    top = retrieved(log, paths, owner).orderBy(F.desc("times"), "path", F.asc_nulls_first("owner")).limit(n)
    return top.join(known, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("path") == F.col("_path")), "left").select("owner", "path", "times", F.coalesce("_is", F.lit(False)).alias("exists"))


def never_retrieved(log: DataFrame, notes: DataFrame, paths: str, owner: str, path: str) -> DataFrame:
    """Notes that no row of the log of the same owner names."""
    named = retrieved(log, paths, owner).select(F.col("owner").alias("_owner"), F.col("path").alias("_path"))
    return notes.join(named, F.col(owner).eqNullSafe(F.col("_owner")) & (F.col(path) == F.col("_path")), "left_anti")


def observed(column: str, stage: str) -> tuple[Column, Column]:
    """(named, overrun): whether a JSON array of objects has one of that stage, and one of it that overran."""
    items = F.from_json(F.col(column), "array<struct<stage:string,overrun:boolean>>")
    named = F.exists(items, lambda x: F.coalesce(x["stage"] == stage, F.lit(False)))
    over = F.exists(items, lambda x: F.coalesce((x["stage"] == stage) & x["overrun"], F.lit(False)))
    return F.coalesce(named, F.lit(False)), F.coalesce(over, F.lit(False))
