"""Readers: trees of Markdown files, exported logs and exported commit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_tree(spark: SparkSession, root: str, snapshot: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, text, hash) of all Markdown files below root but those under dot folders.

    snapshot(path, length, modified) names files that were read before: those that look the same are left out before their
    content is read. Line ends become LF, NUL is removed; a file that isn't UTF-8 has null text and no hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    files = files.withColumn("path", F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")).withColumn("relative", F.expr(f"substr(path, length('{root.rstrip('/')}') + 2)"))
    files = files.where(~F.col("relative").rlike(r"(^|/)\."))
    if snapshot is not None:
        known = snapshot.select(F.col("path").alias("relative"), F.col("length"), F.col("modified").alias("modificationTime"))
        files = files.join(known, ["relative", "length", "modificationTime"], "left_anti")
    text = F.regexp_replace(F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n"), "\u0000", "")
    return files.select(F.col("relative").alias("path"), "length", F.col("modificationTime").alias("modified"), text.alias("text"), F.sha2(text, 256).alias("hash"))


def export(df: DataFrame) -> DataFrame:
    """One JSON line for each row, keys in the order of columns, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def load_export(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of JSON lines(value): rows that fit the schema, and the number of those that don't."""
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.where(good).select("r.*").drop("_bad"), parsed.agg(F.count_if(~good).alias("malformed"))


def last_commits(commits: DataFrame) -> DataFrame:
    """(path, last) of commits(path, at)."""
    return commits.groupBy("path").agg(F.max("at").alias("last"))


def written_when(versions: DataFrame, text: str) -> DataFrame:
    """Versions(path, at, body) in which the number of times that `text` occurs changed."""
    from pyspark.sql import Window

    n = (F.length("body") - F.length(F.replace(F.col("body"), F.lit(text), F.lit("")))) / len(text)
    w = Window.partitionBy("path").orderBy("at")
    return versions.withColumn("n", n.cast("int")).withColumn("was", F.coalesce(F.lag("n").over(w), F.lit(0))).where("n <> was").select("path", "at", "was", "n")
