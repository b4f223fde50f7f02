"""Connected components of links between classes of equal rows, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, met, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("lo", "hi")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    return met(both, least, ["a"], "n", 2 * total).where("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    rest = met(edges, least.where("n > 1"), ["hi"], "n", total).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).union(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a long, b long): component is the least node reachable.

    Every round shuffles the edges only, those of hubs by their other end. Rounds grow with the logarithm of a
    component's diameter. Self-loops give nothing.
    """
    a, b = edges.columns[:2]
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = written(_large_star(now, state[0]), "edges")
        after = written(_small_star(large, state[0]), "edges")
        drop(large)
        drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def resolved(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Joins what tiles found to classes of equal rows.

    classes(cid, rep, size): a class, its least row id and its rows. found(cid, links, root): rows that a
    tile links with others, weighted by the sizes of their classes, and the least class of the tile's own
    component. Gives (cid, n_links, component_id, size): the links of one row of the class and the least
    row id that links reach.
    """
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.select("cid", "root"))
    full = classes.select("cid", "rep", "size").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    full = written(full.select("cid", "rep", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("root")), "classes")
    least = full.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    return met(full, least, ["root"], "n", full.count()).select("cid", "n_links", "component_id", "size")
