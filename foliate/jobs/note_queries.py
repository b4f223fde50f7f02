"""Queries of notes: links by all rules, task lines in full, recurrence rules, coverage, similarity terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import query
from foliate.operators import feed, graph, rules, tasks
from foliate.session import table

_NOTES = r"""WITH named AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_partkey // 3 AS stem,
  p_type || CASE WHEN p_size > 25 THEN '/' || replace(p_brand, '#', '') ELSE '' END AS dir FROM part),
whole AS (SELECT id, stem, dir, dir || '/' || stem || '.md' AS path FROM named),
notes AS (SELECT min(id) AS id, path, any_value(stem) AS stem, any_value(dir) AS dir, length(path) - length(replace(path, '/', '')) AS segments FROM whole GROUP BY path),
edges AS (SELECT o_orderkey, s.dir, CASE o_orderkey % 10 WHEN 0 THEN t.dir || '/' || t.stem WHEN 1 THEN t.path WHEN 2 THEN t.stem WHEN 3 THEN upper(t.stem) WHEN 4 THEN lower(t.path)
  WHEN 5 THEN 'ALIAS ' || t.id // 2 WHEN 6 THEN './' || t.stem WHEN 7 THEN '../' || t.dir || '/' || t.stem WHEN 8 THEN 'Missing ' || t.id ELSE '' END AS name
  FROM orders JOIN whole s ON s.id = o_custkey JOIN whole t ON t.id = o_orderkey * 7 % 200),
bare AS (SELECT *, regexp_replace(name, '\.md$', '') AS ne, name LIKE '%/%' OR name LIKE '%.md' AS styled FROM edges),
full_ AS (SELECT *, CASE WHEN ne LIKE './%' THEN dir || '/' || ne[3:] WHEN ne LIKE '../%' THEN CASE WHEN dir LIKE '%/%' THEN regexp_replace(dir, '/[^/]*$', '') || '/' ELSE '' END || ne[4:] ELSE ne END AS target,
  regexp_extract(ne, '([^/]*)$', 1) AS base FROM bare),
hits AS (SELECT o_orderkey, f.dir AS home, 1 AS rule, n.* FROM full_ f JOIN notes n ON n.path = f.target || '.md' WHERE styled
  UNION ALL SELECT o_orderkey, f.dir, 2, n.* FROM full_ f JOIN notes n ON n.path = f.target WHERE styled
  UNION ALL SELECT o_orderkey, f.dir, 3, n.* FROM full_ f JOIN notes n ON n.path = f.dir || '/' || f.ne || '.md'
  UNION ALL SELECT o_orderkey, f.dir, 4, n.* FROM full_ f JOIN notes n ON n.stem = f.base
  UNION ALL SELECT o_orderkey, f.dir, 5, n.* FROM full_ f JOIN notes n ON lower(n.path) = lower(f.target) || '.md' WHERE styled
  UNION ALL SELECT o_orderkey, f.dir, 6, n.* FROM full_ f JOIN notes n ON lower(n.path) = lower(f.target) WHERE styled
  UNION ALL SELECT o_orderkey, f.dir, 7, n.* FROM full_ f JOIN notes n ON lower(n.path) = lower(f.dir || '/' || f.ne) || '.md'
  UNION ALL SELECT o_orderkey, f.dir, 8, n.* FROM full_ f JOIN notes n ON lower(n.stem) = lower(f.base)
  UNION ALL SELECT o_orderkey, f.dir, 9, n.* FROM full_ f JOIN notes n ON lower('Alias ' || n.id // 2) = lower(f.ne)),
best AS (SELECT o_orderkey, id FROM hits QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY rule, dir <> home, segments, length(path), path) = 1)
SELECT o_orderkey, best.id AS dst FROM edges LEFT JOIN best USING (o_orderkey)"""


def _vault(spark, folder):
    """(edges, notes, aliases): parts as notes, orders as links of every form."""
    key = F.col("p_partkey")
    stem = F.concat(F.initcap("p_name"), F.lit(" "), F.expr("p_partkey div 3").cast("string"))
    where = F.concat("p_type", F.when(F.col("p_size") > 25, F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")))).otherwise(F.lit("")))
    whole = table(spark, folder, "part").select(key.alias("id"), stem.alias("stem"), where.alias("dir")).withColumn("path", F.concat("dir", F.lit("/"), "stem", F.lit(".md")))
    notes = whole.groupBy("path").agg(F.min("id").alias("id"))
    aliases = notes.select("id", F.concat(F.lit("Alias "), F.expr("id div 2").cast("string")).alias("alias"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 7 % 200).alias("t"))
    named = orders.join(whole.select(F.col("id").alias("o_custkey"), F.col("path").alias("source")), "o_custkey").join(whole.withColumnRenamed("id", "t"), "t")
    forms = [
        F.concat("dir", F.lit("/"), "stem"), F.col("path"), F.col("stem"), F.upper("stem"), F.lower("path"), F.concat(F.lit("ALIAS "), F.expr("t div 2").cast("string")),
        F.concat(F.lit("./"), "stem"), F.concat(F.lit("../"), "dir", F.lit("/"), "stem"), F.concat(F.lit("Missing "), F.col("t").cast("string")), F.lit(""),
    ]
    edges = named.select("o_orderkey", "source", F.element_at(F.array(*forms), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("target"))
    return edges, notes, aliases


@query("graph_resolution_all", _NOTES)
def resolution_all(spark, folder):
    return graph.resolved_by_all_rules(*_vault(spark, folder)).select("o_orderkey", "dst")


@query("graph_relinked", _NOTES)
def relinked(spark, folder):
    """Links resolved while some notes still lay elsewhere or had another alias, then brought up to date with the notes as they are."""
    edges, notes, aliases = _vault(spark, folder)
    elsewhere = F.when(F.col("id") % 11 == 0, F.concat(F.lit("Inbox/"), "path")).otherwise(F.col("path"))
    links = graph.linked(edges, notes.withColumn("path", elsewhere), aliases.withColumn("alias", F.when(F.col("id") % 13 != 0, F.col("alias"))))
    return graph.relinked(links, edges, notes, aliases).edges(edges).select("o_orderkey", "dst")


#: Rules by the last digits of an order's number, for the two queries below; the last three are none.
_RULES = [
    "every day", "every 3 days", "every weekday", "every week on Tuesday, friday", "every sunday", "every 2 weeks", "every month", "every 11 months", "every month on the 31st", "every month on the 2nd",
    "every month on the last", "every year when done", "every February on the 28th", "every October on the 1st", "Every 1 days", "every month on the 2th", "every monday, monday",
]
_RULE = f"[{', '.join(repr(r) for r in _RULES)}][1 + o_orderkey % {len(_RULES)}]"


@query("tasks_recurrence_rules", f"""
WITH r AS (SELECT o_orderkey, o_orderkey % {len(_RULES)} AS k, o_orderdate::DATE AS due FROM orders),
d AS (SELECT o_orderkey, k, due, due + step AS day FROM r, (SELECT unnest(range(1, 63))::INT AS step) WHERE k IN (2, 3, 4, 8, 9, 10)),
found AS (SELECT o_orderkey, min(day) AS day FROM d WHERE CASE k WHEN 2 THEN isodow(day) < 6 WHEN 3 THEN isodow(day) IN (2, 5) WHEN 4 THEN isodow(day) = 7 WHEN 8 THEN day(day) = 31 WHEN 9 THEN day(day) = 2 ELSE day = last_day(day) END GROUP BY 1)
SELECT o_orderkey, (CASE k WHEN 0 THEN due + 1 WHEN 1 THEN due + 3 WHEN 5 THEN due + 14 WHEN 6 THEN (due + to_months(1))::DATE WHEN 7 THEN (due + to_months(11))::DATE
  WHEN 11 THEN CASE WHEN strftime(due, '%m%d') <> '0229' THEN (due + to_months(12))::DATE END
  WHEN 12 THEN make_date(year(due) + (strftime(due, '%m%d') >= '0228')::INT, 2, 28) WHEN 13 THEN make_date(year(due) + (strftime(due, '%m%d') >= '1001')::INT, 10, 1)
  ELSE day END)::VARCHAR AS next FROM r LEFT JOIN found USING (o_orderkey)""")
def recurrence_rules(spark, folder):
    text = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("o_orderkey") % len(_RULES) + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due"), tasks.recurrence(text).alias("rule"))
    return rows.select("o_orderkey", tasks.next_by_rule(F.col("rule"), F.col("due")).cast("string").alias("next"))


@query("tasks_line_fields", f"""
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS due, CASE WHEN o_orderstatus = 'F' THEN (o_orderdate::DATE - 3)::VARCHAR END AS scheduled, (o_orderdate::DATE - 9)::VARCHAR AS created,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'highest' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority,
  trim({_RULE}) AS recurrence, 'order/' || o_orderstatus || ' n' || o_custkey AS tags FROM orders""")
def line_fields(spark, folder):
    """Task lines written from orders, with an earlier due date and a broken date that must not count, and what is read back from them."""
    day = lambda n: F.date_sub(F.to_date("o_orderdate"), n).cast("string")
    sign = F.when(F.col("o_orderpriority") == "1-URGENT", "🔺").when(F.col("o_orderpriority") == "2-HIGH", "⏫").when(F.col("o_orderpriority") == "3-MEDIUM", "🔼").when(F.col("o_orderpriority") == "5-LOW", "🔽")
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("o_orderkey") % len(_RULES) + 1).cast("int"))
    parts = [
        F.lit("- [ ] Send"), F.concat(F.lit("#order/"), "o_orderstatus"), F.concat(F.lit("#n"), F.col("o_custkey").cast("string")), F.concat(F.lit("(#order/"), "o_orderstatus", F.lit(")")), F.concat(F.lit("📅 "), day(30)), sign,
        F.concat(F.lit("🔁 "), rule), F.concat(F.lit("➕ "), day(9)), F.lit("✅ 2021-02-30"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("⏳"), day(3))), F.concat(F.lit("📆️ "), day(0)),
    ]
    found = tasks.fields(F.concat_ws(" ", *parts))
    rows = table(spark, folder, "orders").select("o_orderkey", found.alias("f")).where("f.done IS NULL AND f.start IS NULL AND f.cancelled IS NULL")
    return rows.select("o_orderkey", *[F.col(f"f.{c}").cast("string").alias(c) for c in ("due", "scheduled", "created")], "f.priority", "f.recurrence", F.concat_ws(" ", "f.tags").alias("tags"))


@query("feed_uncovered", """
WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS b, o_orderdate::DATE + (1 + o_orderkey % 90)::INT AS e, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS good, o_orderkey % 3 > 0 AS clean FROM orders),
n AS (SELECT a.*, (SELECT min(o.b) FROM r o WHERE o.k = a.k AND o.id <> a.id AND o.b >= a.e) AS next FROM r a),
s AS (SELECT k, b, e, good FROM n UNION ALL SELECT k, e, coalesce(next, '2100-01-01'), clean FROM n WHERE NOT clean OR next IS NOT NULL),
d AS (SELECT DISTINCT k, ('1996-01-01'::DATE + i)::DATE AS day FROM r, (SELECT unnest(range(0, 366))::INT AS i)),
c AS (SELECT d.k, day, coalesce(bool_and(good), false) AS fine FROM d LEFT JOIN s ON s.k = d.k AND s.b <= day AND day < s.e GROUP BY 1, 2),
g AS (SELECT k, day, day - row_number() OVER (PARTITION BY k ORDER BY day)::INT AS run FROM c WHERE NOT fine)
SELECT k AS o_custkey, min(day)::VARCHAR AS uncovered_from, (max(day) + 1)::VARCHAR AS uncovered_to FROM g GROUP BY k, run""")
def uncovered(spark, folder):
    rows = table(spark, folder, "orders").withColumns({"b": F.to_date("o_orderdate"), "e": F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90 + 1).cast("int"))})
    out = feed.uncovered(rows, "o_custkey", "b", "e", "1996-01-01", "1997-01-01", F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 3 > 0)
    return out.select("o_custkey", *[F.col(c).cast("string").alias(c) for c in ("uncovered_from", "uncovered_to")])


@query("tasks_similarity_terms", r"""
WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark)
SELECT item_id, array_to_string(list_transform(list_sort(list_transform(t, lambda x: {'l': -length(x), 'w': x}))[1:8], lambda x: x.w), ' ') AS terms FROM w""")
def similarity_terms(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.concat_ws(" ", tasks.similarity_terms(F.col("text"))).alias("terms"))


@query("tasks_trailing_fields", """
SELECT o_orderkey, o_orderpriority || ' 📅 not yet' AS description, strftime(o_orderdate, '%Y-%m-%d') AS due, CASE WHEN o_orderstatus = 'O' THEN 'high' END AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN 'every 2 weeks' END AS recurrence, CASE WHEN o_orderkey % 2 = 0 THEN '#' || lower(o_orderstatus) ELSE '' END AS tags, 'o' || o_orderkey AS block FROM orders""")
def trailing_fields(spark, folder):
    """Orders as task lines: what stands before the run of fields at their end, and what the run says."""
    when = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    text = F.concat(
        "o_orderpriority", F.lit(" 📅 not yet"), when(F.col("o_orderstatus") == "O", F.lit(" ⏫")), F.lit(" 📅\ufe0f "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" #"), F.lower("o_orderstatus"))), when(F.col("o_orderkey") % 3 == 0, F.lit(" 🔁 every 2 weeks")), F.lit(" ^o"), F.col("o_orderkey").cast("string"),
    )
    found = tasks.trailing_fields(table(spark, folder, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    value = lambda family: F.get(F.filter("fields", lambda f: f["family"] == family), F.lit(0))["value"].alias(family)
    return found.select("o_orderkey", "description", value("due"), value("priority"), value("recurrence"), F.array_join("tags", " ").alias("tags"), "block")


@query("tasks_ruled", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS due, lower(o_orderpriority) AS tag, o_orderkey % 5 = 0 AS tags_cut, o_orderstatus = 'O' AS is_open FROM orders),
v AS (SELECT *, CASE WHEN due IS NOT NULL OR tag = '1-urgent' THEN true WHEN tags_cut THEN NULL ELSE false END AS v FROM t)
SELECT count(*) FILTER (is_open AND coalesce(v, true)) AS kept, count(*) FILTER (is_open AND v IS NULL) AS unsure, count(*) FILTER (is_open AND NOT coalesce(v, true)) AS without_rule, count(*) FILTER (NOT is_open AND coalesce(v, true)) AS without_state FROM v""")
def ruled(spark, folder):
    """Open orders under a rule of fields and tags, with rows that the rule can't judge and those that each group alone leaves out."""
    due = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    rows = table(spark, folder, "orders").select(due.alias("due"), F.array(F.lower("o_orderpriority")).alias("tags"), (F.col("o_orderkey") % 5 == 0).alias("tags_cut"), (F.col("o_orderstatus") == "O").alias("is_open"), F.lit("").alias("text"), F.lit(False).alias("text_cut"))
    return rules.side_counts(rows, {"rule": rules.compiled({"kind": "fields", "tags": ["1-urgent"]}, ["due"]), "state": F.col("is_open")})
