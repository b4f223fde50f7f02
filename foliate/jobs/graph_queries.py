"""Graph and parsing queries over pages, parts, suppliers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import query
from foliate.operators import blocks, graph, parsing, upkeep
from foliate.session import table

_LINKS = """WITH l AS (SELECT page_id AS id, regexp_extract_all(coalesce(html, ''), '<a\\s[^>]*?href="([^"]*)"', 1) AS t FROM pages),
e AS (SELECT id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS target FROM l)"""


def _links(spark, folder):
    return graph.links(table(spark, folder, "pages"), "page_id", "html")


@query("graph_links", _LINKS + " SELECT id, position::INT AS position, target FROM e")
def links(spark, folder):
    return _links(spark, folder)


@query("graph_resolution", _LINKS + r""", n AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*?)(?:\?.*)?$', 1) AS p FROM pages),
s AS (SELECT *, regexp_extract(p, '([^/]+?)(?:\.[a-z]+)?$', 1) AS stem FROM n),
exact AS (SELECT p, min(page_id) AS by_path FROM s GROUP BY p),
closest AS (SELECT stem, page_id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY len(string_split(p, '/')), length(p), p, page_id) AS r FROM s) WHERE r = 1),
t AS (SELECT id, position, ltrim(target, '/') AS target FROM e)
SELECT id, position::INT AS position, coalesce(x.by_path, y.by_path, c.page_id) AS dst FROM t LEFT JOIN exact x ON x.p = t.target
LEFT JOIN exact y ON y.p = 'en/' || t.target LEFT JOIN closest c ON c.stem = regexp_extract(t.target, '([^/]+?)(?:\.[a-z]+)?$', 1)""")
def resolution(spark, folder):
    path = F.regexp_extract("url", r"^https?://[^/]+/(.*?)(?:\?.*)?$", 1)
    notes = table(spark, folder, "pages").select("page_id", path.alias("p"))
    edges = _links(spark, folder).select("id", "position", F.lit("en").alias("folder"), F.ltrim(F.col("target"), F.lit("/")).alias("target"))
    return graph.resolved(edges, notes, "page_id", "p").select("id", "position", "dst")


_EDGES = "WITH e AS (SELECT DISTINCT l_partkey AS a, -l_suppkey AS b FROM lineitem)"


def _edges(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b")).distinct()


@query("graph_neighbourhood", _EDGES + """, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d1 AS (SELECT b AS node, 1 AS distance, min(a) AS via FROM u WHERE a = -1 GROUP BY b HAVING b <> -1),
d2 AS (SELECT b AS node, 2 AS distance, min(a) AS via FROM u WHERE a IN (SELECT node FROM d1) AND b <> -1 AND b NOT IN (SELECT node FROM d1) GROUP BY b),
d3 AS (SELECT b AS node, 3 AS distance, min(a) AS via FROM u WHERE a IN (SELECT node FROM d2) AND b <> -1 AND b NOT IN (SELECT node FROM d1) AND b NOT IN (SELECT node FROM d2) GROUP BY b)
SELECT -1::BIGINT AS node, 0 AS distance, NULL::BIGINT AS via UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3""")
def neighbourhood(spark, folder):
    start = table(spark, folder, "supplier").where("s_suppkey = 1").select((-F.col("s_suppkey")).alias("node"))
    return graph.neighbourhood(_edges(spark, folder), start, 3)


_REFS = "WITH e AS (SELECT l_orderkey AS src, CASE WHEN l_quantity > 5 THEN l_partkey END AS dst FROM lineitem)"


def _refs(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("dst"))


@query("graph_backlinks", _REFS + " SELECT dst AS node, count(DISTINCT src) AS incoming FROM e WHERE dst IS NOT NULL GROUP BY dst")
def backlinks(spark, folder):
    return graph.backlinks(_refs(spark, folder))


@query("graph_orphans", "WITH e AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders) SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def orphans(spark, folder):
    edges = table(spark, folder, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.orphans(table(spark, folder, "customer").select(F.col("c_custkey").alias("node")), edges)


@query("graph_statistics", _REFS + """ SELECT count(*) AS total, count(*) FILTER (WHERE dst IS NULL) AS dangling,
  (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e WHERE dst IS NOT NULL)) AS unlinked FROM e""")
def statistics(spark, folder):
    return graph.statistics(table(spark, folder, "part").select(F.col("p_partkey").alias("node")), _refs(spark, folder))


@query("graph_hubs", _REFS + " SELECT dst AS node, count(DISTINCT src) AS incoming FROM e WHERE dst IS NOT NULL GROUP BY dst ORDER BY incoming DESC, node LIMIT 5")
def hubs(spark, folder):
    return graph.hubs(_refs(spark, folder))


@query("parse_collapsed_length", r"""SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '[\t\n\x0b\f\r ]+', ' ', 'g'))) AS n FROM documents""")
def collapsed_length(spark, folder):
    return table(spark, folder, "documents").select("doc_id", parsing.collapsed_length(F.col("text")).cast("bigint").alias("n"))


@query("parse_chunks")
def chunks(spark, folder):
    found = blocks.chunks(_as_notes(table(spark, folder, "documents")), "doc_id", "text", 1200, 200)
    return found.select("doc_id", "chunk", "start", "end", "section", "path", F.sha2("body", 256).alias("sha"), "cut")


def _as_notes(documents: DataFrame) -> DataFrame:
    """Documents as notes: language and source become tags, the first line a heading, each further line a task or paragraph that links to the source."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.concat(F.when(i % 2 == 0, F.lit("- [ ] ")).otherwise(F.lit("")), x, F.lit(" [["), F.coalesce(F.col("source"), F.lit("none")), F.lit("]]")))
    head = F.concat(F.lit("---\ntags: ["), F.coalesce("lang", F.lit("none")), F.lit(", "), F.coalesce("source", F.lit("none")), F.lit("]\n---\n# "), lines[0])
    return documents.select("doc_id", F.concat_ws("\n", head, F.array_join(rest, "\n")).alias("text"))


@query("parse_markdown")
def markdown(spark, folder):
    return parsing.markdown(_as_notes(table(spark, folder, "documents")), "doc_id", "text")


_OUTLINE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, array_to_string(list_concat(['---' || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || '# ' || l[1]],
  CASE WHEN len(l) = 1 THEN [''] ELSE list_transform(l[2:], lambda x, i: CASE WHEN i % 2 = 1 THEN '- [ ] ' ELSE '' END || x || ' [[' || source || ']]') END), chr(10)) AS t FROM d),
c AS (SELECT doc_id, replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(0), '') AS t FROM n),
x AS (SELECT doc_id, length(t) AS whole, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM c),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x),
h AS (SELECT doc_id, whole, start, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) AS depth, regexp_extract(line, '^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$', 1) AS heading,
  row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ordinal FROM o WHERE regexp_matches(line, '^ {0,3}#{1,6}([ \t].*)?$'))
SELECT doc_id, ordinal::INT AS ordinal, depth::INT AS depth, heading, start::INT AS start,
  (coalesce((SELECT min(b.start) FROM h b WHERE b.doc_id = a.doc_id AND b.ordinal > a.ordinal AND b.depth <= a.depth), whole) - start)::INT AS size FROM h a"""


@query("parse_outline", _OUTLINE)
def outline(spark, folder):
    return blocks.outline(_as_notes(table(spark, folder, "documents")), "doc_id", "text").drop("path")


@query("parse_chunk_lengths")
def chunk_lengths(spark, folder):
    """Deciles of the collapsed lengths of all chunks, how many are under the least length, and of how many notes."""
    found = blocks.chunks(_as_notes(table(spark, folder, "documents")), "doc_id", "text", 1200, 200)
    return upkeep.chunk_lengths(found, "doc_id", parsing.collapsed_length(F.col("body")), blocks.LEAST)
