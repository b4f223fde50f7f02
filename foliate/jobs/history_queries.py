"""Queries of version history and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import query
from foliate.operators import blame, history, upkeep
from foliate.session import table

_STATUS = "CASE l_linestatus WHEN 'F' THEN 'R' ELSE CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'M' END END"


@query("history_commits", f"""
SELECT 'c' || l_orderkey AS commit, o_orderdate::DATE::VARCHAR AS day, o_clerk_ AS author, o_orderpriority AS subject, {_STATUS} AS status,
  'part/' || l_partkey || '.md' AS path, CASE WHEN l_linestatus = 'F' THEN 'old/' || l_suppkey || '.md' END AS from_path
FROM lineitem JOIN (SELECT *, 'u' || o_custkey AS o_clerk_ FROM orders) ON o_orderkey = l_orderkey""")
def commit_records(spark, folder):
    """Orders written as exported commit records, with a line that is no change, and what is read back from them."""
    status = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("R087\told/"), F.col("l_suppkey").cast("string"), F.lit(".md"))).when(F.col("l_returnflag") == "R", "A").otherwise("M")
    change = F.concat(status, F.lit("\tpart/"), F.col("l_partkey").cast("string"), F.lit(".md"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(change), "\n").alias("changes"))
    head = F.concat_ws("\u001f", F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), F.col("o_orderdate").cast("string"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")), "o_orderpriority")
    records = table(spark, folder, "orders").join(lines, "o_orderkey").select(F.concat_ws("\n", head, F.lit("X\tno change"), "changes", F.lit("")).alias("record"))
    return history.commits(records, "record").withColumn("day", F.to_date("at").cast("string")).drop("at")


_CHANGES = """c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 3 THEN 'R' WHEN o_orderkey % 11 = 0 THEN 'A' ELSE 'M' END AS status,
  'n' || o_orderkey * 13 % 200 AS path, 'n' || o_orderkey * 29 % 200 AS src FROM orders)"""


@query("history_lineages", f"""
WITH RECURSIVE {_CHANGES}, b AS (SELECT path, k, CASE WHEN status = 'R' THEN src END AS src FROM c WHERE status <> 'M'),
p AS (SELECT b.path, b.k, b.src, o.k AS up FROM b ASOF LEFT JOIN b o ON o.path = b.src AND o.k < b.k),
t AS (SELECT path, k, path AS root_path, k AS root_at FROM p WHERE up IS NULL UNION ALL SELECT p.path, p.k, t.root_path, t.root_at FROM p JOIN t ON t.path = p.src AND t.k = p.up)
SELECT c.k AS o_orderkey, coalesce(t.root_path, c.path) AS root_path, t.root_at FROM c ASOF LEFT JOIN b ON b.path = c.path AND b.k <= c.k LEFT JOIN t ON t.path = b.path AND t.k = b.k""")
def lineages(spark, folder):
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 3, "R").when(key % 11 == 0, "A").otherwise("M")
    name = lambda k: F.concat(F.lit("n"), (key * k % 200).cast("string"))
    changes = table(spark, folder, "orders").select(key.alias("at"), status.alias("status"), name(13).alias("path"), name(29).alias("from_path"))
    return history.lineages(changes).select(F.col("at").alias("o_orderkey"), "root_path", "root_at")


@query("history_line_origins", """
WITH v AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations),
s AS (SELECT conv_id, v, string_split(coalesce(text, ''), chr(10)) AS x FROM v), u AS (SELECT conv_id, v, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS line FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, v, text ORDER BY line) AS nth FROM u),
z AS (SELECT l.* FROM l JOIN (SELECT conv_id, max(v) AS v FROM v GROUP BY 1) USING (conv_id, v)),
m AS (SELECT z.conv_id, z.line, max(v.v) AS gone FROM z JOIN v ON v.conv_id = z.conv_id LEFT JOIN l ON l.conv_id = z.conv_id AND l.v = v.v AND l.text = z.text AND l.nth = z.nth WHERE l.v IS NULL GROUP BY 1, 2)
SELECT z.conv_id, z.line::INT AS line, z.text, v.turn AS since FROM z LEFT JOIN m USING (conv_id, line) JOIN v ON v.conv_id = z.conv_id AND v.v = coalesce(m.gone, 0) + 1""")
def line_origins(spark, folder):
    return history.line_origins(table(spark, folder, "conversations"), "conv_id", "turn", "text").withColumnRenamed("path", "conv_id")


@query("history_blame")
def line_blame(spark, folder):
    """The turn that each line of the last turn of a conversation dates from, moved or re-indented though it may be."""
    return blame.origins(table(spark, folder, "conversations"), "conv_id", "turn", "text").withColumnRenamed("path", "conv_id")


_FILES = "WITH f AS (SELECT replace(p_type, ' ', '/') || '/' || p_partkey || '.md' AS path FROM part)"


def _files(spark, folder):
    return table(spark, folder, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))


@query("files_listed", _FILES + ", m AS (SELECT path FROM f WHERE starts_with(path, 'STANDARD/') AND regexp_matches(path, '/[^/]*[1-5][^/]\\.md$') ORDER BY path LIMIT 21) SELECT path, (SELECT count(*) > 20 FROM m) AS truncated FROM m ORDER BY path LIMIT 20")
def files_listed(spark, folder):
    return history.listed(_files(spark, folder), "path", "STANDARD/", "*[1-5]?.md", True, 20)


@query("files_excluded", _FILES + " SELECT path FROM f WHERE NOT (path LIKE 'SMALL/%' OR path LIKE '%/COPPER/%' OR path LIKE '%7.md')")
def files_excluded(spark, folder):
    return _files(spark, folder).where(~history.matches_any(F.col("path"), ["SMALL/*", "*/COPPER/*", "*7.md"]))


@query("usage_refusals_coalesced", "SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts) AS opened, min(ts) AS first, count(*) - 1 AS suppressed FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def refusals(spark, folder):
    return upkeep.coalesced(table(spark, folder, "events").where("event_type = 'error'"), "user_id", "ts", "1 hour")


@query("usage_locked", """
SELECT user_id AS key, opened, ts AS locked_at FROM (SELECT user_id, ts, time_bucket(INTERVAL 1 DAY, ts) AS opened, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS n
FROM events WHERE event_type = 'error') WHERE n = 3""")
def locked(spark, folder):
    return upkeep.locked(table(spark, folder, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", "1 day", 3)


@query("usage_recent", "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 100")
def recent(spark, folder):
    return upkeep.newest(table(spark, folder, "events").where("event_type = 'error'").select("event_id", "ts", "user_id"), "ts", "event_id", 100)


@query("usage_newest_of_each", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) <= 5")
def newest_of_each(spark, folder):
    return upkeep.newest_of_each(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 5).select("event_id", "user_id")


@query("corpus_membership", """
SELECT source AS owner, count(*) AS notes, count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS vectors, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents GROUP BY 1""")
def membership(spark, folder):
    made = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return upkeep.membership(table(spark, folder, "documents"), "source", "doc_id", {"vectors": made, "labelled": table(spark, folder, "labels")})


@query("vectors_current_and_historical", "SELECT count(*) FILTER (WHERE label IS NULL OR label % 3 = 0) AS current, count(*) FILTER (WHERE label % 3 <> 0) AS historical FROM embeddings")
def current_and_historical(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.when(F.col("label") % 3 != 0, F.col("label")).alias("valid_to"))
    return upkeep.versions_counted(rows, "valid_to")


@query("backlog_rotation", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey <= 7, s_suppkey)::INT AS place FROM supplier")
def rotation(spark, folder):
    return upkeep.rotated(table(spark, folder, "supplier").select("s_suppkey"), "s_suppkey", 7)


@query("graph_relationships", """
WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
b AS (SELECT src AS node, 'out' AS direction, dst AS other FROM e UNION ALL SELECT dst, 'in', src FROM e)
SELECT node, direction, other, n > 5 AS more FROM (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY other) AS r, count(*) OVER (PARTITION BY node, direction) AS n FROM b) WHERE r <= 5""")
def relationships(spark, folder):
    return upkeep.relationships(table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), 5)


_ROOTS = """WITH r AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '/v/' || s_nationkey WHEN 1 THEN '/v/' || s_nationkey || '/' || s_suppkey ELSE '/v/' || s_nationkey || '/' END AS p FROM supplier),
t AS (SELECT id, rtrim(p, '/') AS p FROM r)"""


@query("roots_overlapping", _ROOTS + " SELECT a.id, b.id AS other, CASE WHEN a.p = b.p THEN 'same' ELSE 'below' END AS relation FROM t a JOIN t b ON a.p = b.p AND a.id < b.id OR starts_with(a.p, b.p || '/')")
def overlapping(spark, folder):
    base = F.concat(F.lit("/v/"), F.col("s_nationkey").cast("string"))
    tail = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("/"), F.col("s_suppkey").cast("string"))).otherwise("/")
    return upkeep.overlapping(table(spark, folder, "supplier").select("s_suppkey", F.concat(base, tail).alias("path")), "s_suppkey", "path")


@query("sink_expired", "SELECT c_custkey FROM customer WHERE c_acctbal < 2000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def expired(spark, folder):
    uses = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.unreferenced(table(spark, folder, "customer"), "c_custkey", uses, F.col("c_acctbal") < 2000).select("c_custkey")
