"""The corpus pipeline: filters, deduplicates and packs the documents of a folder, stage by stage.

Each stage takes (spark, docs, folder) and gives a DataFrame that is written as Parquet and read again as the next stage's docs.
All stages but the last give the columns of docs. Null texts count as empty; rows with null ids are judged as all others; of rows that tie
(equal texts, equal ids) the stages for copies say which one stays; other columns, of any name, are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import op5_exact, op6_language, op7_ngrams, op8_packing, op9_toxicity
from foliate.llm.common import written
from foliate.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the folder's labels, predicts toxic go."""
    return op9_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is clearly of another language than they declare, or of none, go."""
    return op6_language.in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return op5_exact.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarities of 0.8 or more the one with the smallest id stays."""
    return op7_ngrams.without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, packed into sequences."""
    return op8_packing.packed(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("exact", exact), ("near", near), ("packing", packing)]

#: The classifier's and the language model's decisions are not SQL. Tests compare the stages for copies and packing with brute force, and
#: the first two with what their operators say of each row, whose posteriors are compared with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
