"""Links by all rules, recurrence rules, task fields and uncovered intervals at their edges: nulls, ties, empty tables, runs of no length."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from foliate.operators import feed, graph, tasks


def test_rules(spark):
    day = datetime.date
    cases = [
        ("every day", day(2024, 2, 28), day(2024, 2, 29)), ("EVERY  WEEKDAY", day(2024, 3, 1), day(2024, 3, 4)), ("every monday,  sunday", day(2024, 3, 3), day(2024, 3, 4)),
        ("every month", day(2021, 1, 31), day(2021, 2, 28)), ("every month on the 31st", day(2024, 1, 31), day(2024, 3, 31)), ("every month on the last", day(2024, 2, 29), day(2024, 3, 31)),
        ("every year", day(2024, 2, 29), None), ("every year", day(2024, 2, 28), day(2025, 2, 28)), ("every february on the 29th", day(2024, 1, 1), None), ("every march on the 3rd when done", day(2024, 3, 3), day(2025, 3, 3)),
        ("every 1 days", day(2024, 1, 1), None), ("every month on the 11st", day(2024, 1, 1), None), ("every monday, monday", day(2024, 1, 1), None), ("every blue moon", day(2024, 1, 1), None),
        ("every day\n", day(2024, 1, 1), None), ("", day(2024, 1, 1), None), (None, day(2024, 1, 1), None), ("every day", None, None), ("when done", day(2024, 1, 1), None),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, rule string, anchor date, want date")
    for r in df.withColumn("got", tasks.next_by_rule(tasks.recurrence(F.col("rule")), F.col("anchor"))).collect():
        assert r.got == r.want, r


def test_done_moves_the_other_dates(spark):
    df = spark.createDataFrame([("every week when done",), ("every week",), (None,)], "rule string")
    date = lambda x: F.lit(x).cast("date")
    out = df.select("rule", tasks.next_occurrence(F.col("rule"), date("2024-01-10"), date("2024-01-08"), F.lit(None).cast("date"), date("2024-01-12")).alias("n")).collect()
    got = {r.rule: tuple(None if d is None else str(d) for d in r.n) for r in out}
    assert got["every week when done"] == ("2024-01-19", "2024-01-17", None) and got["every week"] == ("2024-01-17", "2024-01-15", None) and got[None] == (None, None, None)


def test_fields(spark):
    rows = [("Pay 📅 2024-01-01 📅", None), ("⏳2024-02-30 📅️ 2024-02-29 #a #a (#b/c) x#no 🔁 every day 🏁 keep", "2024-02-29"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "text string, due string")
    got = [(r.due, None if r.f.due is None else str(r.f.due), r.f) for r in df.select("due", tasks.fields(F.col("text")).alias("f")).collect()]
    assert all(want == have for want, have, _ in got)
    assert got[1][2].tags == ["a"] and got[1][2].recurrence == "every day" and got[1][2].scheduled is None and got[1][2].priority is None


def test_links_by_all_rules(spark):
    notes = spark.createDataFrame([(1, "Home.md"), (2, "a/Plan.md"), (3, "b/Plan.md"), (4, "b/c/Deep.md"), (5, "b/Plan.md"), (6, None), (7, "a/x/Own.md")], "id long, path string")
    aliases = spark.createDataFrame([(4, "The Deep"), (2, None), (3, "home")], "id long, alias string")
    want = [
        ("b/n.md", "Plan", 3), ("z.md", "Plan", 2), ("b/n.md", "a/Plan", 2), ("b/n.md", "a/Plan.md", 2), ("b/c/n.md", "../Plan", 3), ("b/n.md", "./c/Deep.md", 4), ("b/n.md", "plan", 3), ("b/n.md", "A/PLAN", 2),
        ("z.md", "the deep", 4), ("z.md", "home", 1), ("z.md", "None", None), ("z.md", "", None), ("z.md", None, None), (None, "Deep", 4), ("b/n.md", "c/Deep", 4), ("z.md", "q/Own", 7), ("z.md", "Plan", 2),
    ]
    edges = spark.createDataFrame([(*w, k) for k, w in enumerate(want)], "source string, target string, want long, k int")
    got = graph.resolved_by_all_rules(edges, notes, aliases).collect()
    assert len(got) == len(want) and all(r.dst == r.want for r in got), [r for r in got if r.dst != r.want]
    assert graph.resolved_by_all_rules(edges, notes.limit(0)).where("dst IS NOT NULL").count() == 0
    assert graph.resolved_by_all_rules(edges.limit(0), notes, aliases).count() == 0


def test_uncovered_equals_unit_steps(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        for i in range(int(rng.integers(1, 6))):
            b = int(rng.integers(0, 30))
            rows.append((k, i, b, b + int(rng.integers(1, 9)), bool(rng.random() < 0.8), bool(rng.random() < 0.2), bool(rng.random() < 0.6)))
    df = spark.createDataFrame(rows, "k int, i int, b int, e int, m boolean, lossy boolean, clean boolean")
    want = set()
    for k in range(40):
        own, spans = [r for r in rows if r[0] == k], []
        for r in own:
            spans.append((r[2], r[3], r[4] and not r[5]))
            later = [o[2] for o in own if o is not r and o[2] >= r[3]]
            if later or not r[6]:
                spans.append((r[3], min(later, default=10**6), r[6]))
        bad = [t for t in range(5, 35) if (not any(g for a, b, g in spans if a <= t < b)) or any(not g for a, b, g in spans if a <= t < b)]
        for t in bad:
            if t - 1 not in bad:
                end = t
                while end in bad:
                    end += 1
                want.add((k, t, end))
    args = (5, 35, F.col("m"), F.col("lossy"), F.col("clean"))
    got = [tuple(r) for r in feed.uncovered(df, "k", "b", "e", *args).collect()]
    assert set(got) == want and len(got) == len(want)
    assert feed.uncovered(df.limit(0), "k", "b", "e", *args).count() == 0 and feed.uncovered(df, "k", "b", "e", 9, 9, *args[2:]).count() == 0
    one = spark.createDataFrame([(1, 8, 8, True)], "k int, b int, e int, yes boolean")
    assert [tuple(r) for r in feed.uncovered(one, "k", "b", "e", 5, 12, F.col("yes"), ~F.col("yes"), F.col("yes")).collect()] == [(1, 5, 12)]


def test_similarity_terms(spark):
    df = spark.createDataFrame([("b a CCC ccc dd ee",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tasks.similarity_terms(F.col("t"), 3)).collect()] == [["ccc", "dd", "ee"], [], []]
