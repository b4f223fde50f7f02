"""Incremental work, JSON containment, OR in queries and evaluation against plain versions, with nulls and ties."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from foliate.operators import backlog, evaluation, filters, graph, search


def test_budget_equals_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(i), int(c)) for s in ("a", "b", None) for i, c in zip(rng.choice(900, 120, replace=False), rng.integers(0, 50, 120), strict=True)]
    df = spark.createDataFrame(rows, "scope string, at long, cost long")
    for width, budget in itertools.product((1, 50, 10_000), (0, 1, 400, 10**6)):
        want = set()
        for s in ("a", "b", None):
            used = 0
            for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
                if used < budget:
                    want.add(r)
                used += r[2]
        got = [tuple(r) for r in backlog.within_budget(df, "scope", "at", "cost", budget, width).collect()]
        assert set(got) == want and len(got) == len(want), (width, budget)


def test_pending_and_reuse(spark):
    notes = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x"), (5, "z")], "id long, hash string")
    done = spark.createDataFrame([(1, "x"), (2, "old"), (3, None), (9, "x"), (8, "x")], "id long, hash string")
    assert sorted(r.id for r in backlog.pending(notes, done, "id", "hash").collect()) == [2, 4, 5]
    assert sorted((r.id, r.source) for r in backlog.reused(notes, done, "id", "hash").collect()) == [(1, 1), (4, 1)]
    assert backlog.pending(notes, done.limit(0), "id", "hash").count() == 5


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    changes = spark.createDataFrame([("B", 2, False), ("c", 4, None), (None, 1, True)], "v string, k long, gone boolean")
    assert sorted((r.k, r.v or "") for r in backlog.upserted(target, changes, ["k"], F.col("gone")).collect()) == [(2, "B"), (3, ""), (4, "c")]


def test_retrieval_log(spark):
    log = spark.createDataFrame([("a", '["p", "q", "p"]'), (None, '["p"]'), ("a", "{}"), ("a", None), ("a", '["p"]')], "owner string, paths string")
    notes = spark.createDataFrame([("a", "p"), (None, "q"), ("a", "r")], "owner string, path string")
    top = [tuple(r) for r in backlog.most_retrieved(log, notes, "paths", "owner", "path", 5).collect()]
    assert sorted(top, key=str) == sorted([("a", "p", 2, True), (None, "p", 1, False), ("a", "q", 1, False)], key=str)
    assert sorted(tuple(r) for r in backlog.never_retrieved(log, notes, "paths", "owner", "path").select("path").collect()) == [("q",), ("r",)]


def test_json_containment_is_typed_at_every_depth(spark):
    rows = ['{"a":{"x":1}}', '{"a":{"x":"1"}}', '{"a":{"x":1.0,"y":2}}', '{"a":[1,"b",{"c":null}]}', '{"k\'s":true}', "broken", None, '{"a":null}', '{"b":{"a":{"x":1}}}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    found = lambda want: [r.i for r in df.where(filters.contains_json("j", want)).orderBy("i").collect()]
    assert found({"a": {"x": 1}}) == [0, 2] and found({"a": {"x": "1"}}) == [1] and found({"a": ["b"]}) == [3]
    assert found({"a": [{"c": None}, 1]}) == [3] and found({"k's": True}) == [4] and found({"k's": "true"}) == [] and found({"a": None}) == [7]


def test_or_and_negation():
    assert search.parse_query('x OR "y z" w -v OR') == ([[["x"], ["y", "z"]], [["w"]]], [["v"]])
    assert search.parse_query("OR x") == ([[["x"]]], [])


def test_one_of_an_or_group_is_all(spark):
    df = spark.createDataFrame([(1, "only y"), (2, "x"), (3, "none"), (4, None)], "id long, text string")
    assert {r.id: r.match for r in search.keyword(df, "id", "x OR y", 9).collect()} == {1: "all", 2: "all"}


def test_orphans_and_neighbours_of_a_planted_graph(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, None), (9, 4)], "src long, dst long")
    assert sorted(r.node for r in graph.orphans(nodes, edges).collect()) == [3, 5]


def test_thresholds_and_verdict(spark):
    df = spark.createDataFrame([(0.1, True), (0.5, False), (0.9, True), (None, True)], "v double, ok boolean")
    assert sorted(tuple(r) for r in evaluation.thresholds(df, "v", "ok", [0.9, 0.2, 0.95]).collect()) == [(0.2, 2, 1), (0.9, 1, 1)]
    d = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.9), ("b", -0.6), ("c", None)], "arm string, d double")
    assert {r.arm: r.verdict for r in evaluation.verdict(d, ["arm"], "d").collect()} == {"a": "pass", "b": "fail", "c": "empty"}
