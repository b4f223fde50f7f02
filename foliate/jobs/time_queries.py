"""Change-feed and interval queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliate.jobs.registry import query
from foliate.operators import bitemporal, feed, filters
from foliate.session import table
from foliate.storage import written


@query("feed_sequence", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id % 10 AS seq FROM events""")
def sequence(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    last = events.select("user_id", (F.col("user_id") % 10).alias("last_seq")).distinct()
    return feed.sequenced(events, "user_id", ["ts", "event_id"], last).select("event_id", "user_id", "seq")


@query("feed_latest", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest(spark, folder):
    events = table(spark, folder, "events").withColumn("at", F.struct("ts", "event_id"))
    return feed.latest_at(events, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "value")


@query("feed_suppression", """
WITH old AS (SELECT * FROM events WHERE event_id % 2 = 0), new AS (SELECT * FROM events WHERE event_id % 2 = 1),
last AS (SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM old) WHERE r = 1)
SELECT new.event_id, coalesce(last.event_type = new.event_type AND last.ts >= new.ts, false) AS suppressed FROM new LEFT JOIN last USING (user_id)""")
def suppression(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    return feed.suppressed(events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0"), "user_id", "event_type", "event_id", "ts").select("event_id", "suppressed")


_RETAINED = """
WITH w AS (SELECT user_id, event_id, ts, min(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN event_id END) OVER (PARTITION BY user_id) AS live,
  max(event_id) OVER (PARTITION BY user_id) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
k AS (SELECT user_id, event_id FROM w WHERE (event_id >= coalesce(live, newest) AND r <= 20) OR event_id = newest)"""


@query("feed_retention", _RETAINED + " SELECT user_id, event_id FROM k")
def retention(spark, folder):
    return feed.retained(table(spark, folder, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", "2024-01-20", 20).select("user_id", "event_id")


@query("feed_watermarks", _RETAINED + " SELECT user_id, min(event_id) - 1 AS pruned_through FROM k GROUP BY user_id")
def watermarks(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return feed.watermarks(events, feed.retained(events, "user_id", "event_id", "ts", "2024-01-20", 20), "user_id", "event_id")


@query("feed_changes", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type IN ('click', 'view') ORDER BY event_id LIMIT 101")
def changes(spark, folder):
    return feed.changes_since(table(spark, folder, "events").select("event_id", "event_type"), "event_id", 500, ["click", "view"], "event_type", 100)


_CHAIN = """
WITH l AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM l WHERE n = 1 OR p IS DISTINCT FROM event_type),
v AS (SELECT user_id, event_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM c)
"""


def _chain(spark, folder):
    return feed.chained(table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", "event_type", "error").select("user_id", "event_id", "event_type", "valid_from", "valid_to")


@query("intervals_chain", _CHAIN + "SELECT * FROM v WHERE event_type <> 'error' AND (valid_to IS NULL OR valid_from < valid_to)")
def chain(spark, folder):
    return _chain(spark, folder)


@query("intervals_backfilled", _CHAIN + "SELECT * FROM v WHERE event_type <> 'error' AND (valid_to IS NULL OR valid_from < valid_to)")
def backfilled(spark, folder):
    """The chain of a record to which events came in three parts, none of them in the order of their times."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    names = ["user_id", "ts", "event_id", "event_type"]
    record = bitemporal.recorded(events.where("part = 0").drop("part"), *names)
    for part in (1, 2):
        record = written(bitemporal.backfilled(record, events.where(F.col("part") == part).drop("part"), *names)[0], "record")
    return bitemporal.intervals(record, "event_type", "error").select("user_id", "event_id", "event_type", "valid_from", "valid_to")


@query("intervals_as_of", _CHAIN + """SELECT user_id, event_type FROM v WHERE event_type <> 'error' AND (valid_to IS NULL OR valid_from < valid_to)
  AND valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')""")
def as_of(spark, folder):
    return _chain(spark, folder).where(filters.valid_at("2024-01-15 12:00:00")).select("user_id", "event_type")


@query("intervals_current", _CHAIN + "SELECT user_id, event_type FROM v WHERE event_type <> 'error' AND valid_to IS NULL")
def current(spark, folder):
    return _chain(spark, folder).where(filters.current()).select("user_id", "event_type")


_COVER = """
WITH r AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events),
m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT user_id, min(s) AS covered_from, max(e) AS covered_to FROM g GROUP BY user_id, g)
"""


def _covered(spark, folder):
    runs = table(spark, folder, "events").select("user_id", F.col("ts").alias("s"), F.expr("ts + interval 6 hours").alias("e"))
    return feed.merged(runs, "user_id", "s", "e")


@query("intervals_coverage", _COVER + "SELECT * FROM c")
def coverage(spark, folder):
    return _covered(spark, folder)


@query("intervals_gaps", _COVER + """SELECT user_id, covered_to AS gap_from, gap_to FROM (SELECT *, lead(covered_from) OVER (PARTITION BY user_id ORDER BY covered_from) AS gap_to FROM c) WHERE gap_to IS NOT NULL""")
def gaps(spark, folder):
    return feed.gaps(_covered(spark, folder), "user_id")


@query("attribution_as_of", """
SELECT r.event_id, (SELECT s.event_id FROM events s WHERE s.event_type = 'view' AND s.user_id = r.user_id AND s.ts < r.ts AND s.ts >= r.ts - INTERVAL 12 HOUR
  ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS attributed FROM events r WHERE r.event_type = 'click'""")
def attribution(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    searches = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("sid"))
    return feed.attributed(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), searches, ["user_id"], "ts", "12 hours", "sid").select("event_id", "attributed")


@query("snapshot_diff", """
WITH b AS (SELECT 'd/' || doc_id AS p, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
a AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'e/' ELSE 'd/' END || doc_id AS p, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0),
lost AS (SELECT * FROM b WHERE p NOT IN (SELECT p FROM a)), found AS (SELECT * FROM a WHERE p NOT IN (SELECT p FROM b)),
moves AS (SELECT l.p AS old, f.p AS new FROM (SELECT h, min(p) AS p FROM lost GROUP BY h HAVING count(*) = 1) l JOIN (SELECT h, min(p) AS p FROM found GROUP BY h HAVING count(*) = 1) f USING (h))
SELECT 'move' AS kind, new AS path, old AS from_path FROM moves UNION ALL SELECT 'delete', p, NULL FROM lost WHERE p NOT IN (SELECT old FROM moves)
UNION ALL SELECT 'create', p, NULL FROM found WHERE p NOT IN (SELECT new FROM moves) UNION ALL SELECT 'modify', a.p, NULL FROM a JOIN b USING (p) WHERE a.h <> b.h""")
def diff(spark, folder):
    docs = table(spark, folder, "documents")
    before = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("d/"), "doc_id").alias("p"), F.sha2("text", 256).alias("h"))
    folder_ = F.when(F.col("doc_id") % 5 == 0, "e/").otherwise("d/")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where("doc_id % 4 <> 0").select(F.concat(folder_, "doc_id").alias("p"), F.sha2(text, 256).alias("h"))
    return feed.snapshot_diff(before, after, "p", "h")


@query("windows_tumbling", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, folder):
    w = F.window("ts", "1 minute")
    return table(spark, folder, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "event_type", "n")


@query("windows_sessions", """
WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, folder):
    s = F.session_window("ts", "30 minutes")
    return table(spark, folder, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), "n")


@query("conversation_turns", """
SELECT conv_id, count(*) AS turns, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing FROM conversations GROUP BY conv_id""")
def turns(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("missing"))


@query("stream_minute_counts", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_minute_counts(spark, folder):
    from foliate.streaming import events

    out = events.finished(events.window_counts(events.read(spark, folder, "events"), "ts", "event_type", late=None), ["start", "event_type"], "minutes")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def stream_sequence(spark, folder):
    from foliate.streaming import events

    rows = events.read(spark, folder, "events").select("event_id", "user_id", "ts")
    return events.sequence_whole(rows, "user_id", ["ts", "event_id"], "sequence").select("event_id", "user_id", "seq")


@query("feed_appended", """
WITH e AS (SELECT user_id AS scope, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS append, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS item, event_type AS path, value >= 100 AS lost FROM events),
a AS (SELECT scope, append, count(*) FILTER (NOT lost) AS n, count(*) FILTER (lost) AS misses FROM e GROUP BY ALL),
g AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY scope ORDER BY append ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM a),
l AS (SELECT scope, max(append) FILTER (n > 0) AS append, sum(misses) AS misses FROM g GROUP BY scope, coalesce(run, 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY scope, append ORDER BY item) AS r FROM e WHERE NOT lost),
f AS (SELECT scope, append, 0 AS r, 'gap' AS kind, NULL AS path, 'write_failed' AS gap_reason, misses AS gap_count FROM l WHERE misses > 0 AND append IS NOT NULL
  UNION ALL SELECT scope, append, r, 'modified', path, NULL, NULL FROM k WHERE r <= 3
  UNION ALL SELECT scope, append, 4, 'gap', NULL, 'pass_overflow', n - 3 FROM a WHERE n > 3)
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY append, r) AS seq, append, kind, path, gap_reason, gap_count::BIGINT AS gap_count FROM f""")
def feed_appended(spark, folder):
    """Every user's events of a day as one append to the user's feed, of which three are kept; large values stand for events that were lost."""
    from foliate.storage import scratch
    from foliate.streaming import feed

    day = Window.partitionBy("user_id", F.col("ts").cast("date"))
    rows = table(spark, folder, "events").withColumns({"item": F.row_number().over(day.orderBy("ts", "event_id")), "items": F.count("*").over(day)})
    rows = rows.withColumn("append", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.col("ts").cast("date"))))
    none, lost = F.lit(None).cast("string"), F.col("value") >= 100
    values = {"kind": F.when(lost, feed.MISS).otherwise("modified"), "path": F.col("event_type"), "from_path": none, "hash": none, "reason": none, "count": F.when(lost, 1), "quiet": F.lit(False)}
    types = {f.name: f.dataType for f in feed.ITEM}
    log = rows.select(F.col("user_id").alias("scope"), *(values.get(n, F.col(n)).cast(t).alias(n) for n, t in types.items()))
    at = scratch(spark, "log")
    log.repartition(4, "path").write.parquet(at)  # an append is spread over files
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(at)
    return feed.record(stream, "scope", scratch(spark, "feed"), 3).select("scope", "seq", "append", "kind", "path", "gap_reason", "gap_count")
