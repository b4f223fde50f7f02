"""Usage, filter and task queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.jobs.registry import query
from foliate.operators import filters, tasks, usage
from foliate.session import table

# A call counts as refused where its parameter k is a multiple of 10; k then says how many were suppressed with it.


def _k():
    return usage.param("props", "k")


def _refused():
    return F.coalesce(_k().try_cast("int") % 10 == 0, F.lit(False))


@query("usage_tool_aggregates", """
WITH e AS (SELECT event_type AS tool, value, json_extract_string(props, '$.k') AS k FROM events),
f AS (SELECT *, coalesce(try_cast(k AS INT) % 10 = 0, false) AS refused FROM e)
SELECT tool, count(*) FILTER (WHERE NOT refused) AS executed,
  coalesce(sum(1 + CASE WHEN regexp_full_match(k, '[0-9]{1,9}') THEN k::BIGINT ELSE 0 END) FILTER (WHERE refused), 0)::BIGINT AS refused,
  quantile_cont(value, 0.5) FILTER (WHERE NOT refused) AS p50, quantile_cont(value, 0.95) FILTER (WHERE NOT refused) AS p95,
  quantile_cont(value, 0.99) FILTER (WHERE NOT refused) AS p99,
  avg(try_cast(k AS BIGINT)) FILTER (WHERE NOT refused) AS mean_size, max(try_cast(k AS BIGINT)) FILTER (WHERE NOT refused) AS max_size
FROM f GROUP BY tool""")
def tool_aggregates(spark, folder):
    return usage.tool_aggregates(table(spark, folder, "events"), "event_type", "value", _refused(), _k(), _k().try_cast("bigint"))


@query("usage_phase_breakdown", """
SELECT event_type AS tool, count(*) AS n, avg(k) AS mean, quantile_cont(k, 0.95) AS p95
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL GROUP BY event_type""")
def phase_breakdown(spark, folder):
    return usage.phase_breakdown(table(spark, folder, "events"), "event_type", _k().try_cast("double"))


@query("usage_grouping_sets", """
SELECT cls, tool, GROUPING(cls)::INT AS g_cls, GROUPING(tool)::INT AS g_tool, count(*) AS n, quantile_cont(value, 0.95) AS p95
FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'read' ELSE 'write' END AS cls, event_type AS tool, value FROM events)
GROUP BY GROUPING SETS ((cls, tool), (cls), ())""")
def grouping_sets(spark, folder):
    return usage.tool_table(table(spark, folder, "events"), F.when(F.col("user_id") % 2 == 0, "read").otherwise("write"), "event_type", "value")


@query("usage_counter_totals", """
SELECT event_type AS metric, count(*) AS total, max(value) AS peak FROM events GROUP BY event_type""")
def counter_totals(spark, folder):
    return usage.counter_totals(table(spark, folder, "events"), "event_type", F.col("value"))


@query("usage_chart_series", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def chart_series(spark, folder):
    return usage.chart_series(table(spark, folder, "events"), "ts")


@query("usage_actor_totals", "SELECT user_id AS actor, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY user_id")
def actor_totals(spark, folder):
    return usage.actor_totals(table(spark, folder, "events"), "user_id", "ts")


@query("usage_queries", """
SELECT k AS query, count(*) AS n, count(r) AS readable, avg(r) AS mean_results, count(*) FILTER (WHERE r = 0) AS zero
FROM (SELECT json_extract_string(props, '$.k') AS k, CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT % 4 END AS r FROM events)
WHERE k IS NOT NULL GROUP BY k""")
def grouped_queries(spark, folder):
    return usage.grouped_queries(table(spark, folder, "events"), _k(), F.when(F.col("event_type") != "view", F.floor("value") % 4))


@query("usage_slowest", "SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 50")
def slowest(spark, folder):
    return usage.slowest(table(spark, folder, "events").select("event_id", "event_type", "value"), "value", "event_id")


@query("usage_quota_replay", """
SELECT user_id, ts::DATE::VARCHAR AS day, rank, event_id, rank <= 3 AS admitted FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INT AS rank FROM events)""")
def quota_replay(spark, folder):
    return usage.admitted(table(spark, folder, "events"), "user_id", "ts", "event_id", 3).select("user_id", F.col("day").cast("string").alias("day"), "rank", "event_id", "admitted")


@query("usage_consumed_on_day", """
SELECT user_id AS key, count(*) AS n FROM events WHERE ts::DATE = (SELECT min(ts)::DATE FROM events) GROUP BY user_id""")
def consumed(spark, folder):
    events = table(spark, folder, "events")
    day = events.agg(F.to_date(F.min("ts")).alias("d"))
    return events.join(F.broadcast(day), F.to_date("ts") == F.col("d"), "left_semi").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))


@query("usage_configurations", """
SELECT status, month, sum(n)::BIGINT AS n FROM (
  SELECT o_orderstatus AS status, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT l_linestatus, month(l_shipdate), count(*) FROM lineitem GROUP BY ALL) GROUP BY status, month""")
def configurations(spark, folder):
    first = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"), F.month("o_orderdate").cast("bigint").alias("month"))
    second = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("status"), F.month("l_shipdate").cast("bigint").alias("month"))
    return usage.configurations(first, second, "status", "month")


@query("usage_with_owners", """
SELECT c_name AS owner, (o_custkey IS NOT NULL AND c_custkey IS NULL) AS owner_missing, count(*) AS n, sum(o_totalprice) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def with_owners(spark, folder):
    rows = usage.with_dimensions(table(spark, folder, "orders"), "o_custkey", table(spark, folder, "customer"), "c_custkey", "c_name")
    return rows.groupBy("owner", "owner_missing").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("usage_dashboard", """
SELECT count(*) AS total, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending, count(*) FILTER (WHERE n_chars > 10000) AS truncated, count(DISTINCT text) AS distinct_texts
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def dashboard(spark, folder):
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("k")).distinct()
    rows = table(spark, folder, "documents").join(known, F.col("doc_id") == F.col("k"), "left")
    return usage.dashboard(rows, "text", F.col("k").isNull(), F.col("n_chars") > 10000)


@query("usage_readiness", """
SELECT tool, n, ok, (ok * 100 >= n * 90 AND n > 0) AS ready FROM (
  SELECT event_type AS tool, count(*) AS n, count(*) FILTER (WHERE value < 100) AS ok FROM events GROUP BY 1)""")
def readiness(spark, folder):
    stats = table(spark, folder, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 100).alias("ok"))
    return usage.readiness(stats, 90, 100)


@query("usage_distinct_tools", "SELECT DISTINCT event_type AS tool FROM events")
def distinct_tools(spark, folder):
    return table(spark, folder, "events").select(F.col("event_type").alias("tool")).distinct()


@query("filter_notes", """
SELECT doc_id, lang, source FROM documents WHERE source IS NOT DISTINCT FROM 'src3' AND starts_with(lang, 'e') AND n_chars > 500""")
def filter_notes(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(filters.owned("source", "src3") & filters.in_folder("lang", "e") & (F.col("n_chars") > 500)).select("doc_id", "lang", "source")


@query("filter_json_containment", """
SELECT event_id FROM events WHERE json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract_string(props, '$.k')::DOUBLE = 7""")
def json_containment(spark, folder):
    return table(spark, folder, "events").where(filters.contains_json("props", {"k": 7})).select("event_id")


@query("filter_tags", """
WITH t AS (SELECT p_partkey, [lower(replace(p_type, ' ', '/')), lower(p_brand)] AS tags FROM part)
SELECT p_partkey, len(list_filter(tags, lambda t: t = 'standard' OR starts_with(t, 'standard/'))) > 0 AS under,
  list_contains(tags, 'brand#11') AS branded,
  array_to_string(list_sort(list_distinct(flatten(list_transform(tags, lambda t: list_transform(range(1, len(string_split(t, '/')) + 1), lambda i: array_to_string(string_split(t, '/')[1:i], '/')))))), ',') AS prefixes
FROM t""")
def filter_tags(spark, folder):
    tags = F.array(F.lower(F.regexp_replace("p_type", " ", "/")), F.lower("p_brand"))
    parts = table(spark, folder, "part").withColumn("tags", tags)
    return parts.select("p_partkey", filters.under_any(F.col("tags"), ["standard"]).alias("under"), filters.has_tags("tags", ["brand#11"]).alias("branded"), F.array_join(filters.tag_prefixes(F.col("tags")), ",").alias("prefixes"))


@query("filter_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def filter_terms(spark, folder):
    docs = table(spark, folder, "documents").withColumn("fold", F.lower("text"))
    return docs.where(filters.all_terms("fold", ["the", "license"])).select("doc_id")


@query("page_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 101")
def page_first(spark, folder):
    return filters.page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 100)


@query("page_next", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000.0 OR (o_totalprice = 250000.0 AND o_orderkey > 10)
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 101""")
def page_next(spark, folder):
    return filters.page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 100, [250000.0, 10])


@query("page_budget", """
SELECT o_custkey, o_orderkey, running FROM (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) WHERE running <= 60""")
def page_budget(spark, folder):
    return filters.fitting(table(spark, folder, "orders"), "o_custkey", "o_orderkey", F.length("o_orderpriority"), 60).select("o_custkey", "o_orderkey", "running")


_DUE = "o_orderdate::DATE"
_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'highest' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END"


def _orders_as_tasks(spark, folder):
    names = {"1-URGENT": "highest", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    priority = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("o_orderpriority")]
    due = F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("note_id"), F.col("o_orderstatus").alias("status"), priority.alias("priority"), due.alias("due"), F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(F.to_date("o_orderdate"), 10)).alias("scheduled"), F.col("o_orderpriority").alias("text")
    )


_TASKS = f"""WITH tasks AS (SELECT o_orderkey, o_custkey AS note_id, o_orderstatus AS status, {_PRIORITY} AS priority,
  CASE WHEN o_orderkey % 3 <> 0 THEN {_DUE} END AS due, CASE WHEN o_orderkey % 2 = 0 THEN ({_DUE} - 10)::DATE END AS scheduled, o_orderpriority AS text FROM orders)"""


@query("tasks_side_counts", _TASKS + """
, p AS (SELECT coalesce(status = 'O', false) AS s, coalesce(due IS NOT NULL, false) AS d, coalesce(priority IN ('highest', 'high'), false) AS r FROM tasks)
SELECT count(*) FILTER (WHERE s AND d AND r) AS kept, count(*) FILTER (WHERE d AND r AND NOT s) AS without_status,
  count(*) FILTER (WHERE s AND r AND NOT d) AS without_due, count(*) FILTER (WHERE s AND d AND NOT r) AS without_priority FROM p""")
def side_counts(spark, folder):
    groups = {"status": F.coalesce(F.col("status") == "O", F.lit(False)), "due": F.col("due").isNotNull(), "priority": F.coalesce(F.col("priority").isin("highest", "high"), F.lit(False))}
    return tasks.side_counts(_orders_as_tasks(spark, folder), groups)


@query("tasks_list", _TASKS + """
SELECT o_orderkey, due::VARCHAR AS due, CASE priority WHEN 'highest' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 4 WHEN 'lowest' THEN 5 ELSE 3 END::INT AS rank
FROM tasks WHERE status = 'O' ORDER BY tasks.due ASC NULLS LAST, rank, o_orderkey LIMIT 201""")
def task_list(spark, folder):
    rows = _orders_as_tasks(spark, folder).where("status = 'O'").select("o_orderkey", "due", tasks.priority_rank(F.col("priority")).alias("rank"))
    return filters.page(rows, [("due", False), ("rank", False), ("o_orderkey", False)], 200).withColumn("due", F.col("due").cast("string"))


_AGENDA = _TASKS + """, s AS (SELECT *, CASE WHEN due < DATE '1997-06-01' THEN 'overdue' WHEN due = DATE '1997-06-01' THEN 'today'
  WHEN due > DATE '1997-06-01' AND due <= DATE '1997-06-08' THEN 'upcoming' WHEN scheduled <= DATE '1997-06-01' AND due IS NULL THEN 'scheduled'
  WHEN scheduled <= DATE '1997-06-01' AND due > DATE '1997-06-08' THEN 'later' END AS section FROM tasks WHERE status = 'O')"""


@query("tasks_agenda", _AGENDA + """
SELECT section, place, o_orderkey FROM (SELECT section, o_orderkey, row_number() OVER (PARTITION BY section ORDER BY due, scheduled, o_orderkey)::INT AS place FROM s WHERE section IS NOT NULL)
WHERE place <= CASE section WHEN 'overdue' THEN 25 WHEN 'today' THEN 25 WHEN 'upcoming' THEN 50 ELSE 15 END""")
def agenda(spark, folder):
    rows, _ = tasks.agenda(_orders_as_tasks(spark, folder).where("status = 'O'"), "due", "scheduled", "1997-06-01", 7, [F.asc_nulls_last("due"), F.asc_nulls_last("scheduled"), F.asc("o_orderkey")])
    return rows.select("section", "place", "o_orderkey")


@query("tasks_agenda_totals", _AGENDA + " SELECT section, count(*) AS total FROM s WHERE section IS NOT NULL GROUP BY section")
def agenda_totals(spark, folder):
    return tasks.agenda(_orders_as_tasks(spark, folder).where("status = 'O'"), "due", "scheduled", "1997-06-01", 7, [F.asc("o_orderkey")])[1]


@query("tasks_recurrence", """
WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS due, 1 + o_orderkey % 5 AS n, ['day', 'week', 'month', 'year'][1 + o_orderkey % 4] AS u FROM orders)
SELECT o_orderkey, (CASE u WHEN 'day' THEN due + n::INT WHEN 'week' THEN due + (7 * n)::INT WHEN 'month' THEN due + to_months(n::INT) ELSE due + to_months((12 * n)::INT) END)::DATE::VARCHAR AS next_due,
  ((CASE u WHEN 'day' THEN due + n::INT WHEN 'week' THEN due + (7 * n)::INT WHEN 'month' THEN due + to_months(n::INT) ELSE due + to_months((12 * n)::INT) END)::DATE - 3)::DATE::VARCHAR AS next_scheduled FROM r""")
def recurrence(spark, folder):
    unit = F.element_at(F.array(*map(F.lit, ["day", "week", "month", "year"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, folder, "orders").withColumns({"due": F.to_date("o_orderdate"), "rule": F.concat(F.lit("every "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(" "), unit, F.lit("s"))})
    n = tasks.next_occurrence(F.col("rule"), F.col("due"), F.date_sub("due", 3), F.lit(None).cast("date"))
    return rows.select("o_orderkey", n["due"].cast("string").alias("next_due"), n["scheduled"].cast("string").alias("next_scheduled"))


@query("tasks_keys", """
WITH k AS (SELECT o_orderkey, o_custkey, substr(sha256('task'::BLOB || '\\x00'::BLOB || o_orderpriority::BLOB), 1, 12) AS key FROM orders)
SELECT o_orderkey, key, row_number() OVER (PARTITION BY o_custkey, key ORDER BY o_orderkey)::INT AS key_ordinal, count(*) OVER (PARTITION BY o_custkey, key) AS key_count FROM k""")
def task_keys(spark, folder):
    rows = table(spark, folder, "orders").withColumn("key", tasks.task_key(F.col("o_orderpriority"), "task"))
    return tasks.with_ordinals(rows, "o_custkey", "key", "o_orderkey").select("o_orderkey", "key", "key_ordinal", "key_count")


@query("tasks_similar", r"""
WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS na, len(b.t) AS nb FROM w a JOIN w b ON a.item_id < b.item_id)
SELECT a, b, s / least(na, nb) AS containment, s / (na + nb - s) AS jaccard FROM p WHERE s > 0 AND greatest(s / least(na, nb), s / (na + nb - s)) >= 0.2""")
def similar(spark, folder):
    from foliate.operators.search import terms

    rows = table(spark, folder, "benchmark").select("item_id", terms(F.col("text")).alias("terms"))
    pairs = tasks.similar_descriptions(rows.withColumnRenamed("item_id", "a"), rows.withColumnRenamed("item_id", "b"), 0.2)
    return pairs.where("a < b")
