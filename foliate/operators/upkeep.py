"""Upkeep of logs and collections: windows of refusals, newest rows, membership, rotation, relationships and overlapping roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.storage import written


def coalesced(events: DataFrame, key: str, time: str, width: str) -> DataFrame:
    """(key, opened, first, suppressed): one row for all events of a key in a fixed window; suppressed: those after the first."""
    w = F.window(time, width)
    return events.groupBy(w.alias("_w"), F.col(key).alias("key")).agg(F.min(time).alias("first"), (F.count("*") - 1).alias("suppressed")).select("key", F.col("_w.start").alias("opened"), "first", "suppressed")


def locked(failures: DataFrame, key: str, time: str, order: str, width: str, most: int) -> DataFrame:
    """(key, opened, locked_at): fixed windows in which a key failed at least `most` times, and the time of the failure that locked it."""
    w = F.window(time, width).start
    rows = failures.select(F.col(key).alias("key"), w.alias("opened"), F.col(time).alias("locked_at"), F.col(order).alias("_order"))
    rank = F.row_number().over(Window.partitionBy("key", "opened").orderBy("locked_at", "_order"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == most).select("key", "opened", "locked_at")


def newest(log: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The n newest rows; rows without a time come last, ties by key."""
    return log.orderBy(F.desc_nulls_last(time), key).limit(n)


def newest_of_each(log: DataFrame, scope: str, time: str, key: str, n: int) -> DataFrame:
    """The n newest rows of every scope, null being one of its own; ties by the greater key."""
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc_nulls_last(time), F.desc(key)))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def membership(notes: DataFrame, owner: str, id_col: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Per owner: notes, and for each of tables (their id column named as that of notes) how many of them it has a row for."""
    rows = notes.select(F.col(owner).alias("owner"), F.col(id_col).alias("_id"))
    for name, other in tables.items():
        ids = other.select(F.col(id_col).alias("_id")).distinct().withColumn(name, F.lit(1))
        rows = rows.join(ids, "_id", "left")
    return rows.groupBy("owner").agg(F.count("*").alias("notes"), *[F.count(name).alias(name) for name in tables])


def versions_counted(vectors: DataFrame, valid_to: str) -> DataFrame:
    """How many rows hold now and how many did."""
    return vectors.agg(F.count_if(F.col(valid_to).isNull()).alias("current"), F.count_if(F.col(valid_to).isNotNull()).alias("historical"))


def rotated(owners: DataFrame, id_col: str, cursor: object) -> DataFrame:
    """Rows with place: those after the cursor first, then those up to it, by id. Without a cursor all are after it. One row an owner.

    Rows are sorted by ranges and numbered in each; what is added to a range is how many rows those before it have. No task orders all.
    """
    wrapped = F.lit(False) if cursor is None else F.col(id_col) <= F.lit(cursor)
    n = int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the low 33 bits of this id number the rows of a partition, the others number the partitions
    parts = written(owners.repartitionByRange(n, wrapped, F.col(id_col)).sortWithinPartitions(wrapped, id_col).withColumn("_at", F.monotonically_increasing_id()), "rotated")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, seen = [], 0
    for r in parts.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        before.append((r["p"], seen))
        seen += r["count"]
    offsets = F.broadcast(owners.sparkSession.createDataFrame(before, "_p long, _before long"))
    return parts.join(offsets, part == F.col("_p")).withColumn("place", (F.col("_before") + row + 1).cast("int")).drop("_at", "_p", "_before")


def relationships(edges: DataFrame, n: int) -> DataFrame:
    """(node, direction, other, more) of edges(src, dst): up to n different neighbours of each node and direction, by number, and whether there are more."""
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    both = whole.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")).union(whole.select("dst", F.lit("in"), "src"))
    rank = F.row_number().over(Window.partitionBy("node", "direction").orderBy("other"))
    first = both.withColumn("_rank", rank).where(F.col("_rank") <= n + 1)  # hubs are cut to n + 1 before the shuffle
    more = F.max("_rank").over(Window.partitionBy("node", "direction")) > n
    return first.withColumn("more", more).where(F.col("_rank") <= n).drop("_rank")


def overlapping(roots: DataFrame, id_col: str, path: str) -> DataFrame:
    """(id, other, relation): pairs of roots with the same path ('same', once, the smaller id first) or of which one lies below the other ('below').

    Every path meets others on the folders that it lies in, by equality: no pair of paths is compared.
    """
    rows = roots.select(F.col(id_col).alias("id"), F.rtrim(F.col(path), F.lit("/")).alias("path")).where("path IS NOT NULL")
    parts = F.split("path", "/")
    above = rows.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("at"))
    met = above.join(rows.select(F.col("id").alias("other"), F.col("path").alias("at")), "at")
    same = F.col("path") == F.col("at")
    return met.where(~same | (F.col("id") < F.col("other"))).select("id", "other", F.when(same, "same").otherwise("below").alias("relation"))


def unreferenced(rows: DataFrame, key: str, references: DataFrame, old: Column) -> DataFrame:
    """Rows to expire: old ones whose key no reference(key) names."""
    named = references.select(F.col(key).alias("_key")).where("_key IS NOT NULL")
    return rows.where(old).join(named, F.col(key) == F.col("_key"), "left_anti")


def chunk_lengths(chunks: DataFrame, note: str, length: Column, least: int) -> DataFrame:
    """One row: d1 to d9, the deciles of a length over all chunks (the first value that so many reach), n, under (chunks shorter than
    `least`), notes, and notes_under that have such a chunk.

    Values are counted before they are ordered, so what one task orders are different lengths, which a window bounds.
    """
    rows = chunks.select(F.col(note).alias("note"), length.alias("length"))
    values = rows.groupBy("length").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("length"))
    every = F.sum("n").over(Window.partitionBy(F.lit(1)))
    ranked = values.withColumns({"upto": upto, "every": every})
    found = ranked.agg(*[F.min(F.when(F.col("upto") * 10 >= F.col("every") * k, F.col("length"))).alias(f"d{k}") for k in range(1, 10)], F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("length") < least, F.col("n"))), F.lit(0)).alias("under"))
    notes = rows.groupBy("note").agg(F.min("length").alias("shortest")).agg(F.count("*").alias("notes"), F.count_if(F.col("shortest") < least).alias("notes_under"))
    return found.crossJoin(notes)
