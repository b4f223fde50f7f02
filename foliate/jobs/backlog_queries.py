"""Queries of incremental work, retrieval logs, composed search and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import text
from foliate.jobs.registry import indexed, query
from foliate.operators import backlog, evaluation, filters, search, textindex, vectors
from foliate.session import table


@query("backlog_pending", """
SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE NOT coalesce(e.vec_id IS NOT NULL AND (CASE WHEN e.label % 2 = 0 THEN md5(d.text) END) IS NOT DISTINCT FROM md5(d.text), false)""")
def pending(spark, folder):
    notes = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("hash"))
    made = table(spark, folder, "embeddings").join(notes.withColumnRenamed("doc_id", "vec_id"), "vec_id")
    done = made.select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, F.col("hash")).alias("hash"))
    return backlog.pending(notes, done, "doc_id", "hash").select("doc_id")


@query("backlog_within_budget", """
SELECT doc_id, source, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS used FROM documents) WHERE used < 50000""")
def within_budget(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return backlog.within_budget(rows, "source", "doc_id", "n_chars", 50000)


@query("backlog_reuse", """
WITH done AS (SELECT md5(text) AS h, min(doc_id) AS source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND text IS NOT NULL GROUP BY 1)
SELECT doc_id, done.source FROM documents d JOIN done ON done.h = md5(d.text) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def reuse(spark, folder):
    notes = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("hash"))
    made = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return backlog.reused(notes.join(made, "doc_id", "left_anti"), notes.join(made, "doc_id", "left_semi"), "doc_id", "hash")


@query("sink_upsert", """
WITH c AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v, max(o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM c) UNION ALL SELECT k, v FROM c WHERE s <> 'O'""")
def upsert(spark, folder):
    target = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    changes = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.max("o_orderstatus").alias("status"))
    return backlog.upserted(target, changes, ["c_custkey"], F.col("status") == "O")


def _log(spark, folder):
    """Orders as searches whose result list holds their parts; open orders have no owner."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.sort_array(F.collect_list(F.col("l_partkey").cast("string")))).alias("result_paths"))
    return table(spark, folder, "orders").join(lines, "o_orderkey").select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("owner"), "result_paths")


def _notes(spark, folder):
    return table(spark, folder, "part").select(F.when(F.col("p_size") > 10, "F").alias("owner"), F.col("p_partkey").cast("string").alias("path"))


_LOG = """WITH log AS (SELECT DISTINCT CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS owner, o_orderkey, l_partkey::VARCHAR AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
named AS (SELECT owner, path, count(*) AS times FROM log GROUP BY owner, path),
notes AS (SELECT CASE WHEN p_size > 10 THEN 'F' END AS owner, p_partkey::VARCHAR AS path FROM part)"""


@query("usage_most_retrieved", _LOG + """, top AS (SELECT * FROM named ORDER BY times DESC, path, owner NULLS FIRST LIMIT 50)
SELECT owner, path, times, EXISTS (SELECT 1 FROM notes n WHERE n.owner IS NOT DISTINCT FROM top.owner AND n.path = top.path) AS exists FROM top""")
def most_retrieved(spark, folder):
    return backlog.most_retrieved(_log(spark, folder), _notes(spark, folder), "result_paths", "owner", "path", 50)


@query("usage_never_retrieved", _LOG + """
SELECT owner, path FROM notes WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.owner IS NOT DISTINCT FROM notes.owner AND n.path = notes.path)""")
def never_retrieved(spark, folder):
    return backlog.never_retrieved(_log(spark, folder), _notes(spark, folder), "result_paths", "owner", "path")


@query("usage_stage_pressure", """
SELECT l_orderkey AS id, bool_or(l_returnflag = 'R') AS pressured, bool_or(l_returnflag = 'R' AND l_tax > 0.05) AS overrun FROM lineitem GROUP BY 1""")
def stage_pressure(spark, folder):
    item = F.struct(F.col("l_returnflag").alias("stage"), (F.col("l_tax") > 0.05).alias("overrun"))
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(item)).alias("observed"))
    named, over = backlog.observed("observed", "R")
    return rows.select("id", named.alias("pressured"), over.alias("overrun"))


@query("filter_json_nested", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey > 100")
def json_nested(spark, folder):
    inner = F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") > 100).alias("large"), F.col("o_custkey").alias("key"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct(inner.alias("order"), F.array("o_orderpriority", F.lit("x")).alias("marks"))).alias("data"))
    return rows.where(filters.contains_json("data", {"order": {"status": "F", "large": True}, "marks": ["1-URGENT"]})).select("o_orderkey")


_TAGS = "WITH t AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w, p_type, p_size FROM part)"


def _tagged(spark, folder):
    """Parts with tags: the words of their type as a tag and what lies under it."""
    return table(spark, folder, "part").withColumn("tags", F.array(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.concat(F.lit("size/"), F.col("p_size").cast("string"))))


@query("filter_tags_none", "SELECT p_partkey FROM part WHERE NOT (lower(p_type) = 'standard' OR lower(p_type) LIKE 'standard %' OR p_size = 7)")
def tags_none(spark, folder):
    return _tagged(spark, folder).where(filters.under_none(F.col("tags"), ["Standard", "size/7"])).select("p_partkey")


@query("filter_tags_all", "SELECT p_partkey FROM part WHERE (lower(p_type) = 'standard' OR lower(p_type) LIKE 'standard %') AND p_size = 7")
def tags_all(spark, folder):
    return _tagged(spark, folder).where(filters.under_all(F.col("tags"), ["standard", "size/7"])).select("p_partkey")


@query("tasks_listed", """
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate::DATE BETWEEN '1995-01-01' AND '1996-12-31'
  AND (CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END IN ('1-URGENT') OR o_orderpriority = '5-LOW')
  AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'o') AND contains(lower(o_orderpriority || ' ' || o_orderstatus), '-')""")
def tasks_listed(spark, folder):
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    folded = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    wanted = filters.one_of(F.col("o_orderstatus"), ["O", "P"]) & filters.in_range(F.col("o_orderdate").cast("date"), "1995-01-01", "1996-12-31")
    return table(spark, folder, "orders").where(wanted & filters.one_of(priority, ["1-URGENT", None]) & filters.has_words(folded, ["O", "-"])).select("o_orderkey")


_SPACED = r"regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\p{L}\p{N}]+', ' ', 'g')"


@query("keyword_or", f"""
WITH t AS (SELECT doc_id AS id, {_SPACED} AS d FROM documents),
m AS (SELECT id, (contains(d, ' license ') OR contains(d, ' copyright '))::INT + contains(d, ' version ')::INT AS matched FROM t)
SELECT id, matched, round(matched * 0.02, 6) AS score, CASE WHEN matched = 2 THEN 'all' ELSE 'any' END AS match FROM m WHERE matched > 0
ORDER BY match <> 'all', score DESC, id LIMIT 100""")
def keyword_or(spark, folder):
    return textindex.keyword(indexed(spark, folder, {"text": "D"}), "license OR copyright version", 100)


@query("hybrid_search", f"""
WITH n AS (SELECT doc_id AS id, {_SPACED} AS d FROM documents WHERE lang = 'en'),
m AS (SELECT id, contains(d, ' license ')::INT + contains(d, ' version ')::INT AS matched FROM n),
w AS (SELECT id, row_number() OVER (ORDER BY matched < 2, matched DESC, id) AS keyword_rank, matched = 2 AS every FROM m WHERE matched > 0 QUALIFY keyword_rank <= 100),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS similarity FROM embeddings, q WHERE vec_id IN (SELECT id FROM n)),
v AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS vector_rank FROM s QUALIFY vector_rank <= 100),
b AS (SELECT coalesce(w.id, v.id) AS id, keyword_rank, vector_rank, similarity, every, round(coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 12) AS score FROM w FULL JOIN v ON w.id = v.id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, least(keyword_rank, vector_rank), id) AS place, keyword_rank, vector_rank, similarity,
  CASE WHEN vector_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'vector' ELSE 'both' END AS matched_in,
  CASE WHEN coalesce(bool_or(every) OVER (), false) OR max(similarity) OVER () >= 0.5 THEN 'ok' ELSE 'low' END AS confidence FROM b QUALIFY place <= 20""")
def hybrid_search(spark, folder):
    rows = table(spark, folder, "embeddings")
    like = rows.agg(F.min_by("embedding", "vec_id")).first()[0]  # the query's vector
    notes = table(spark, folder, "documents")
    return search.hybrid(notes, rows.withColumnRenamed("vec_id", "doc_id"), F.col("lang") == "en", "doc_id", "text", "embedding", "license version", like, 20)


_TOP = """WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS id, q.label = d.label AS right, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS x
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) AS rank FROM s)"""


@query("evaluation_thresholds", _TOP + """, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9, 0.95])::DOUBLE AS threshold)
SELECT threshold, count(*) AS answered, count(*) FILTER (WHERE r.right) AS right FROM t JOIN r ON r.x >= threshold WHERE rank <= 10 GROUP BY threshold""")
def threshold_table(spark, folder):
    rows = table(spark, folder, "embeddings")
    found = vectors.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10)
    labels = rows.select("vec_id", "label")
    both = found.join(labels.toDF("qid", "a"), "qid").join(labels.toDF("id", "b"), "id").select("similarity", (F.col("a") == F.col("b")).alias("right"))
    return evaluation.thresholds(both, "similarity", "right", [0.1, 0.3, 0.5, 0.7, 0.9, 0.95])


_RUNS = """WITH r AS (SELECT o_custkey AS q, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)"""


@query("evaluation_novelty", _RUNS + " SELECT q, count(*) FILTER (WHERE b > 5) / count(*) AS novelty FROM r WHERE a <= 5 GROUP BY q")
def novelty(spark, folder):
    from pyspark.sql import Window

    own = Window.partitionBy("q")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"), "o_totalprice", "o_orderdate")
    run = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "i")))
    base = rows.withColumn("rank", F.row_number().over(own.orderBy("o_orderdate", "i")))
    return evaluation.novelty(run, base, "q", "i", 5)


@query("evaluation_verdict", """
WITH d AS (SELECT l_linestatus AS arm, l_discount - l_tax AS delta FROM lineitem)
SELECT arm, count(delta) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (WHERE delta < -0.07) AS losses,
  CASE WHEN count(delta) = 0 THEN 'empty' WHEN avg(delta) >= 0.005 AND count(*) FILTER (WHERE delta < -0.07) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM d GROUP BY arm""")
def verdict(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("arm"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return evaluation.verdict(rows, ["arm"], "delta", 0.005, -0.07).withColumn("mean", F.round("mean", 6))


@query("text_expressions", r"""
SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.1f', length(html) / 1024.0) || ' KB' ELSE printf('%.1f', length(html) / 1048576.0) || ' MB' END AS size,
  CASE WHEN NOT list_contains(string_split(p, '/'), '..') THEN array_to_string(list_filter(string_split(p, '/'), lambda s: s <> '' AND s <> '.'), '/') END AS path
FROM (SELECT page_id, html, '/./' || url || '//' AS p FROM pages)""")
def expressions(spark, folder):
    rows = table(spark, folder, "pages")
    return rows.select("page_id", text.human_size(F.length("html")).alias("size"), text.normal_path(F.concat(F.lit("/./"), "url", F.lit("//"))).alias("path"))
