"""Cover density, excerpts and bootstrap intervals over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import indexed, query
from foliate.operators import evaluation, ranking, textindex, vectors
from foliate.operators.search import WEIGHTS
from foliate.session import table

_UNITS = ["license", "version"]
_PARTS = {"source": WEIGHTS["A"], "text": WEIGHTS["D"]}


def _split(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({column}, ''), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_COVERS = f"""
WITH p AS (SELECT doc_id AS id, {_split("source")} AS a, {_split("text")} AS d FROM documents),
h AS (SELECT * FROM (SELECT id, generate_subscripts(a, 1) - 1 AS pos, lower(unnest(a)) AS term, 1::DOUBLE AS weight FROM p
  UNION ALL SELECT id, generate_subscripts(d, 1) - 1 + len(a), lower(unnest(d)), 0.02::DOUBLE FROM p) WHERE term IN ('license', 'version')),
r AS (SELECT *, row_number() OVER w AS n, sum(1 / weight) OVER w AS s FROM h WINDOW w AS (PARTITION BY id ORDER BY pos)),
l AS (SELECT *, max(CASE WHEN term = 'license' THEN n END) OVER w AS x, max(CASE WHEN term = 'version' THEN n END) OVER w AS y FROM r WINDOW w AS (PARTITION BY id ORDER BY pos)),
f AS (SELECT *, least(x, y) AS b FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY pos) AS last FROM f),
c AS (SELECT g.id, r.pos AS begin, g.pos AS fin, (g.n - r.n + 1) / (g.s - r.s + 1 / r.weight) / (1 + g.pos - r.pos - g.n + r.n) AS value
  FROM g JOIN r ON r.id = g.id AND r.n = g.b WHERE last IS NULL OR g.b > last),
k AS (SELECT id, count(*) AS covers, round(sum(value), 6) AS score FROM c GROUP BY id)
"""


def _density(spark, folder, n):
    return textindex.density(indexed(spark, folder, {"source": "A", "text": "D"}), _UNITS, n)


@query("keyword_density", _COVERS + "SELECT id, covers, score FROM k ORDER BY score DESC, id LIMIT 50")
def keyword_density(spark, folder):
    return _density(spark, folder, 50).drop("best")


@query("keyword_snippets", _COVERS + """, t AS (SELECT id, score FROM k ORDER BY score DESC, id LIMIT 20),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(value, 9) DESC, begin) AS o FROM c)
SELECT id, score, array_to_string(list_transform(list_slice(list_concat(a, d), greatest(begin - 4, 0) + 1, greatest(begin - 4, 0) + least(greatest(fin - begin + 9, 6), 18)),
  lambda w: CASE WHEN lower(w) IN ('license', 'version') THEN '<b>' || w || '</b>' ELSE w END), ' ') AS snippet
FROM t JOIN m USING (id) JOIN p USING (id) WHERE o = 1""")
def keyword_snippets(spark, folder):
    return ranking.snippets(table(spark, folder, "documents"), "doc_id", _density(spark, folder, 20), _UNITS, list(_PARTS))


@query("keyword_parts", r"""
WITH d AS (SELECT doc_id AS id, ' ' || regexp_replace(lower(coalesce(source, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS a, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS b FROM documents),
m AS (SELECT id, contains(a, ' src7 ') AS s1, contains(b, ' src7 ') AS s2, contains(a, ' version ') AS v1, contains(b, ' version ') AS v2 FROM d),
k AS (SELECT *, (s1 OR s2)::INT + (v1 OR v2)::INT AS matched, s1::INT + s2::INT * 0.02 + v1::INT + v2::INT * 0.02 AS score FROM m),
t AS (SELECT * FROM k WHERE matched > 0 ORDER BY matched < 2, score DESC, id LIMIT 200)
SELECT id, matched, CASE WHEN matched = 2 THEN CASE WHEN s1 AND v1 AND s2 AND v2 THEN 'source,text' WHEN s1 AND v1 THEN 'source' WHEN s2 AND v2 THEN 'text' ELSE 'source+text' END
  WHEN (s1 OR v1) AND (s2 OR v2) THEN 'source,text' WHEN s1 OR v1 THEN 'source' ELSE 'text' END AS matched_in FROM t""")
def keyword_parts(spark, folder):
    index = indexed(spark, folder, {"source": "A", "text": "D"})
    found = textindex.keyword(index, "src7 version", 200)
    where = textindex.matched_in(index, "src7 version", found, {"A": "source", "D": "text"})
    return found.join(where, "id").select("id", "matched", F.array_join("matched_in", ",").alias("matched_in"))


_ARM = """SELECT q.vec_id AS qid, (q.label = d.label)::INT AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity({q}, {d}) DESC, d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0"""
_FULL = _ARM.format(q="q.embedding::DOUBLE[]", d="d.embedding::DOUBLE[]")
_HALF = _ARM.format(q="q.embedding[:32]::DOUBLE[]", d="d.embedding[:32]::DOUBLE[]")


@query("evaluation_interval", f"""
WITH a AS (SELECT qid, avg(hit) AS v FROM ({_FULL}) WHERE rank <= 10 GROUP BY qid), b AS (SELECT qid, avg(hit) AS v FROM ({_HALF}) WHERE rank <= 10 GROUP BY qid),
e AS (SELECT qid, b.v - a.v AS delta FROM a JOIN b USING (qid)),
u AS (SELECT delta, r, ('0x' || substr(md5(concat_ws('/', 0, r, qid)), 1, 8))::BIGINT AS u FROM e, range(1000) t(r)),
w AS (SELECT delta, r, {" + ".join(f"(u >= {t})::INT" for t in evaluation.POISSON)} AS w FROM u),
m AS (SELECT r, sum(w * delta) / sum(w) AS mean FROM w GROUP BY r HAVING sum(w) > 0)
SELECT 'half' AS arm, (SELECT count(*) FROM e) AS n, (SELECT round(avg(delta), 6) FROM e) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def evaluation_interval(spark, folder):
    """Precision of the first ten neighbours by half of the vector less that by all of it, over every query vector."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    asked = rows.select(F.col("vec_id").alias("qid"), F.col("label").alias("want")).where("qid % 100 = 0")
    got = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("got"))
    arms = None
    for name, arm in (("full", rows), ("half", rows.withColumn("embedding", F.slice("embedding", 1, 32)))):
        run = vectors.nearest(arm.where("vec_id % 100 = 0"), arm, "vec_id", "embedding", 10).select(F.lit(name).alias("arm"), "qid", "id")
        arms = run if arms is None else arms.union(run)
    values = arms.join(got, "id").join(asked, "qid").groupBy("arm", "qid").agg(F.avg((F.col("got") == F.col("want")).cast("int")).alias("value"))
    found = evaluation.interval(evaluation.paired(values, "arm", "qid", "value", "full"), ["arm"], "qid", "delta")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})
