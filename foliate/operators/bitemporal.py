"""Late versions merged into validity intervals: what is known of a key changes only around the versions that came late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a late version does to the record of its key.
INSERT, REPEAT, HIDE, SHOW, CLOSE, STAMP = "insert", "repeat", "hide", "show", "close", "stamp"


def recorded(versions: DataFrame, key: str, time: str, order: str, value: str) -> DataFrame:
    """versions(key, time, order, value) with shown, valid_from and valid_to.

    A version is shown if its value is not that of the version before it, by (time, order); the others are kept, without an interval, as a
    late version may part them from what they repeat. An interval ends where the next shown one begins; the last one is open.
    """
    own = Window.partitionBy(key).orderBy(time, order)
    before = F.lag(F.struct(F.col(value).alias("v"))).over(own)
    marked = versions.withColumn("shown", before.isNull() | ~before["v"].eqNullSafe(F.col(value)))
    following = F.min(F.when(F.col("shown"), F.col(time))).over(own.rowsBetween(1, Window.unboundedFollowing))
    return marked.withColumns({"valid_from": F.when(F.col("shown"), F.col(time)), "valid_to": F.when(F.col("shown"), following)})


def intervals(record: DataFrame, value: str, gone: str | None = None) -> DataFrame:
    """The intervals of a record as feed.chained() gives them: without those of no length and those whose value says that the key is gone."""
    rows = record.where("shown AND (valid_to IS NULL OR valid_from < valid_to)").drop("shown")
    return rows if gone is None else rows.where(~F.col(value).eqNullSafe(F.lit(gone)))


def backfilled(record: DataFrame, late: DataFrame, key: str, time: str, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(the record with late(key, time, order, value), what changed: the rows of it that are new or other, each with its action).

    Actions: insert (a late version with an interval), repeat (a late one that says what the one before it says), hide and show (a known one
    begins to repeat what now stands before it, or no longer does), close (a known interval ends elsewhere), stamp (hide or show where the
    open interval's begin moves). Only rows of keys that late names are read again and ordered; all others go through unchanged. A version
    that is there already, by key, time and order, changes nothing. Keys and times are not null.

    Any order of arrival, in whatever parts, gives the record of all versions at once.
    """
    base = [key, time, order]
    keys = late.select(key).distinct()
    old = record.join(keys, key, "left_semi")
    new = late.select(*base, value).dropDuplicates(base).join(old.select(*base), base, "left_anti")
    was = old.select(*base, F.col("shown").alias("_shown"), F.col("valid_to").alias("_to"), F.lit(True).alias("_known"))
    again = recorded(old.select(*base, value).unionByName(new), key, time, order, value).join(was, base, "left")
    known = F.coalesce("_known", F.lit(False))
    turned = F.col("shown") != F.col("_shown")
    opened = F.col("valid_to").isNull() & F.col("_to").isNull()
    last = F.max(F.struct(time, order)).over(Window.partitionBy(key))
    action = (
        F.when(~known & F.col("shown"), INSERT)
        .when(~known, REPEAT)
        .when(turned & opened & (F.struct(time, order) == last), STAMP)
        .when(turned, F.when(F.col("shown"), SHOW).otherwise(HIDE))
        .when(~F.col("valid_to").eqNullSafe(F.col("_to")), CLOSE)
    )
    told = again.withColumn("action", action)
    columns = [*base, value, "shown", "valid_from", "valid_to"]
    whole = record.select(*columns).join(keys, key, "left_anti").unionByName(told.select(*columns))
    return whole, told.where("action IS NOT NULL").select(*columns, "action")
