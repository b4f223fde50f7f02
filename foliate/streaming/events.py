"""Structured Streaming over an event log: counts by window, sequences and rate limits."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliate.storage import scratch


def read(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A table as a stream of its files, `files` of them in each micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parquet*")


def window_counts(stream: DataFrame, time: str, key: str, width: str = "1 minute", late: str | None = "1 hour") -> DataFrame:
    """Events per window and key; rows later than `late` behind the watermark are left out and state is dropped.

    Without `late` there is no watermark: every row counts in whatever order files come, and state holds every window.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def finished(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an aggregation over all data there is, in update mode; the last update of each key stands.

    Every batch is written under its number, so a batch that is run again writes the same files.
    """
    spark = stream.sparkSession
    out, at = scratch(spark, name), scratch(spark, name + "-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(os.path.join(out, f"batch={number:06d}"))

    stream.writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out + "/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def sequence_batches(stream: DataFrame, scope: str, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers per scope over micro-batches: a single writer adds each batch after the last numbers written.

    The last number of every scope is a table of its own beside each batch, so a batch reads one such table and not what came before.
    """
    spark = stream.sparkSession
    out, at, ends = scratch(spark, name), scratch(spark, name + "-state"), scratch(spark, name + "-last")
    last = T.StructType([stream.schema[scope], T.StructField("last", T.LongType())])
    schema = T.StructType([*stream.schema.fields, T.StructField("seq", T.LongType())])

    def add(batch: DataFrame, number: int) -> None:
        rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order)).cast("bigint")
        rows = batch.withColumn("seq", rank)
        if number:
            before = spark.read.schema(last).parquet(os.path.join(ends, f"batch={number - 1:06d}"))
            met = before.withColumnRenamed(scope, "_scope")
            rows = rows.join(met, F.col(scope).eqNullSafe(F.col("_scope")), "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0))).drop("last", "_scope")
        rows.select(*[f.name for f in schema]).write.mode("overwrite").parquet(os.path.join(out, f"batch={number:06d}"))
        now = spark.read.schema(schema).parquet(os.path.join(out, f"batch={number:06d}")).select(scope, F.col("seq").alias("last"))
        both = now.union(before) if number else now
        both.groupBy(scope).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(os.path.join(ends, f"batch={number:06d}"))

    stream.writeStream.option("checkpointLocation", at).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out + "/*")


def sequence_whole(stream: DataFrame, scope: str, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers per scope over all data there is, in `order` whatever batch a row came in.

    Every batch is written under its number, and rows are numbered once all are there; sequence_batches() numbers by arrival.
    """
    spark = stream.sparkSession
    out, at = scratch(spark, name), scratch(spark, name + "-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={number:06d}"))

    stream.writeStream.option("checkpointLocation", at).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order)).cast("bigint")
    return spark.read.schema(stream.schema).parquet(out + "/*").withColumn("seq", rank)


def token_bucket(stream: DataFrame, key: str, time: str, rate: float, burst: float) -> DataFrame:
    """(key, time, admitted) for every event: a bucket per key fills at `rate` a second up to `burst`, an event takes one."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(time)
        admitted = []
        for t in rows[time].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9:
            tokens = min(burst, tokens + max(0.0, t - last) * rate) if last is not None else tokens
            last = t if last is None else max(last, t)
            admitted.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: group[0], time: rows[time].to_numpy(), "admitted": admitted})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(time).cast("timestamp").alias(time))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
