"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import indexed, query
from foliate.operators import search, textindex, vectors
from foliate.session import table

_NEAREST = """
WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS id, d.label, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity,
  list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id)::INT AS rank FROM s)
"""


def _nearest(spark, folder, k):
    rows = table(spark, folder, "embeddings")
    return vectors.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", k)


@query("vector_top_k", _NEAREST + "SELECT qid, id, similarity, rank FROM r WHERE rank <= 10")
def vector_top_k(spark, folder):
    return _nearest(spark, folder, 10).withColumn("similarity", F.round("similarity", 6))


@query("vector_first_of_each", _NEAREST + """, f AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM r WHERE rank <= 50),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS place FROM f WHERE n = 1)
SELECT qid, label AS grp, id, rank, place FROM g WHERE place <= 5""")
def vector_first_of_each(spark, folder):
    ranked = _nearest(spark, folder, 50)
    return vectors.first_of_each(ranked, table(spark, folder, "embeddings"), "vec_id", "label", 5).select("qid", "grp", "id", "rank", "place")


@query("vector_related", """
WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY label, pos),
v AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY label),
s AS (SELECT a.label, b.label AS other, list_cosine_similarity(a.v, b.v) AS x FROM v a JOIN v b ON a.label <> b.label)
SELECT label, other, rank FROM (SELECT label, other, row_number() OVER (PARTITION BY label ORDER BY x DESC, other)::INT AS rank FROM s) WHERE rank <= 3""")
def vector_related(spark, folder):
    means = vectors.mean_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    found = vectors.nearest(means, means, "label", "mean", 3)
    return found.select(F.col("qid").cast("int").alias("label"), F.col("id").cast("int").alias("other"), "rank")


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_KEYWORD = f"""
WITH t AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
m AS (SELECT id, list_contains(w, 'license')::INT + list_contains(w, 'version')::INT AS matched, list_contains(w, 'apache') AS bad FROM t),
k AS (SELECT id, matched, round(matched * 0.02, 6) AS score, CASE WHEN matched = 2 THEN 'all' ELSE 'any' END AS match FROM m WHERE matched > 0 AND NOT bad)
"""


def _keyword(spark, folder, text, n):
    return textindex.keyword(indexed(spark, folder, {"text": "D"}), text, n)


@query("keyword_search", _KEYWORD + "SELECT id, matched, score, match FROM k ORDER BY match <> 'all', score DESC, id LIMIT 50")
def keyword_search(spark, folder):
    return _keyword(spark, folder, "license version -apache", 50)


@query("keyword_phrase", r"""
SELECT doc_id AS id, 1 AS matched, 0.02::DOUBLE AS score, 'all' AS match FROM documents
WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ', ' all rights reserved ') ORDER BY id LIMIT 50""")
def keyword_phrase(spark, folder):
    return _keyword(spark, folder, '"all rights reserved"', 50)


@query("keyword_terms", f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term""")
def keyword_terms(spark, folder):
    return search.term_statistics(table(spark, folder, "documents"), "doc_id", "text")


@query("keyword_index", f"""
WITH t AS (SELECT doc_id AS id, generate_subscripts({_WORDS}, 1) - 1 AS pos, unnest({_WORDS}) AS term FROM documents)
SELECT term, id, count(*) AS tf, min(pos)::INT AS first FROM t GROUP BY term, id""")
def keyword_index(spark, folder):
    return search.index_of(table(spark, folder, "documents"), "doc_id", "text")


@query("tag_counts", "SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, tag LIMIT 50")
def tag_counts(spark, folder):
    docs = table(spark, folder, "documents").select(F.explode(F.array("lang")).alias("tag"))
    return docs.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(50)


_FUSED = """
WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)),
b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type) AS rank FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY ALL)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
f AS (SELECT user_id, event_type, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best FROM u GROUP BY ALL)
SELECT user_id, event_type, round(score, 6) AS score, best::INT AS best, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, best, event_type)::INT AS place FROM f
"""


@query("fusion_arms", _FUSED)
def fusion_arms(spark, folder):
    from pyspark.sql import Window

    events = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    arm = lambda c: events.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(c), "event_type")))
    return search.fused([arm("n"), arm("m")], ["user_id", "event_type"]).withColumn("score", F.round("score", 6))


@query("hybrid_confidence", _NEAREST + """SELECT qid, round(max(x), 6) AS top, CASE WHEN max(x) < 0.6 THEN 'low' ELSE 'ok' END AS confidence FROM r WHERE rank <= 10 GROUP BY qid""")
def hybrid_confidence(spark, folder):
    top = _nearest(spark, folder, 10).groupBy("qid").agg(F.max("similarity").alias("x"))
    return top.select("qid", F.round("x", 6).alias("top"), search.confidence(F.lit(False), F.col("x"), 0.6).alias("confidence"))


_RERANK = _NEAREST + """, c AS (SELECT qid, label, id, 1 - similarity AS distance, min(rank) OVER (PARTITION BY qid, label)::INT AS note_rank FROM r WHERE rank <= 50),
i AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY distance, id) AS i FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i > 1, CASE WHEN i = 1 THEN note_rank END NULLS FIRST, distance, label, id)::INT AS slot FROM i WHERE i <= 4)
"""


def _allocated(spark, folder):
    from pyspark.sql import Window

    ranked = _nearest(spark, folder, 50).join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    rows = ranked.withColumns({"distance": 1 - F.round("similarity", 6), "note_rank": F.min("rank").over(Window.partitionBy("qid", "label"))})
    return search.allocated(rows, "qid", "label", "note_rank", "distance", "id", 20)


@query("rerank_allocation", _RERANK + 'SELECT qid, label, id, slot, i = 1 AS "primary" FROM z WHERE slot <= 20')
def rerank_allocation(spark, folder):
    return _allocated(spark, folder).select("qid", "label", "id", "slot", "primary")


@query("rerank_places", _RERANK + """, b AS (SELECT qid, label, max(-distance) AS score, min(slot) AS was FROM z WHERE slot <= 20 GROUP BY qid, label)
SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was)::INT AS place FROM b""")
def rerank_places(spark, folder):
    rows = _allocated(spark, folder).withColumn("s", -F.col("distance"))
    return search.reranked(rows, "qid", "label", "slot", "s").select("qid", "label", "place")


@query("retrieval_metrics", _NEAREST + """, j AS (SELECT q.vec_id AS qid, d.vec_id AS id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
h AS (SELECT qid, count(*) AS h, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM r SEMI JOIN j ON r.qid = j.qid AND r.id = j.id WHERE rank <= 10 GROUP BY qid),
n AS (SELECT qid, count(*) AS r FROM j GROUP BY qid)
SELECT n.qid, round(coalesce(h.h, 0) / n.r, 6) AS recall, round(coalesce(1.0 / h.f, 0.0)::DOUBLE, 6) AS rr,
  round(coalesce(h.dcg / list_sum(list_transform(range(1, least(n.r, 10) + 1), lambda i: 1 / log2(i + 1))), 0.0), 6) AS ndcg FROM n LEFT JOIN h USING (qid)""")
def retrieval_metrics(spark, folder):
    rows = table(spark, folder, "embeddings")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    judged = q.join(rows.select(F.col("vec_id").alias("id"), "label"), "label").where("qid <> id").select("qid", "id")
    m = search.retrieval_metrics(_nearest(spark, folder, 10), judged, "qid", "id", 10)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


@query("query_classes", r"""SELECT CASE WHEN regexp_matches(url, '[0-9_/\\.:#]|[a-z][A-Z]') THEN 'identifier' ELSE 'prose' END AS class, count(*) AS n FROM pages GROUP BY 1""")
def query_classes(spark, folder):
    return table(spark, folder, "pages").groupBy(search.classified(F.col("url")).alias("class")).agg(F.count("*").alias("n"))
