"""Cover density, excerpts and bootstrap intervals against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from foliate.operators import evaluation, ranking


def plain_covers(words, weights, units):
    """Shortest spans by trying all of them."""
    holds = [(b, e) for b in range(len(words)) for e in range(b, len(words)) if units <= set(words[b : e + 1])]
    out = []
    for b, e in holds:
        if not any((b, e) != (x, y) and b <= x and y <= e for x, y in holds):
            hits = [weights[k] for k in range(b, e + 1) if words[k] in units]
            out.append((b, e, round(len(hits) / sum(1 / w for w in hits) / (1 + e - b + 1 - len(hits)), 9)))
    return out


def test_covers_against_all_spans(spark):
    rng = random.Random(3)
    notes = [(i, " ".join(rng.choices("abcx", k=rng.randrange(4))), " ".join(rng.choices("aBcxyz", k=rng.randrange(25)))) for i in range(60)]
    df = spark.createDataFrame([*notes, (60, None, None), (61, "", "a , b")], "id int, title string, body string")
    for units in (["a"], ["a", "b"], ["c", "a", "b"]):
        got = ranking.covers(df, "id", units, {"title": 1.0, "body": 0.02}).orderBy("id", "begin").collect()
        want = []
        for i, title, body in [*notes, (61, "", "a b")]:
            a, d = title.lower().split(), body.lower().split()
            want += [(i, *c) for c in plain_covers(a + d, [1.0] * len(a) + [0.02] * len(d), set(units))]
        assert [(r.id, r.begin, r.end, round(r.value, 9)) for r in got] == want


def test_snippet(spark):
    df = spark.createDataFrame([(1, "T", "one two three four five License of Version six seven eight nine ten"), (2, None, "version 2 license"), (3, "license", None)], "id int, title string, body string")
    ranked = ranking.density(df, "id", ["license", "version"], {"title": 1.0, "body": 0.02}, 5)
    got = {r.id: r.snippet for r in ranking.snippets(df, "id", ranked, ["license", "version"], ["title", "body"]).collect()}
    assert got == {1: "two three four five <b>License</b> of <b>Version</b> six seven eight nine", 2: "<b>version</b> 2 <b>license</b>"}
    assert ranking.density(df.limit(0), "id", ["license"], {"body": 0.02}, 5).count() == 0


def test_interval(spark):
    rng = random.Random(5)
    rows = [("a", i, rng.gauss(0.5, 1)) for i in range(400)] + [("b", i, 2.0) for i in range(30)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "arm string, qid int, delta double")
    got = {r.arm: r for r in evaluation.interval(df, ["arm"], "qid", "delta").collect()}
    again = {r.arm: r for r in evaluation.interval(df.repartition(5).orderBy(F.rand(1)), ["arm"], "qid", "delta").collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 400 and got["a"].low == pytest.approx(again["a"].low)
    assert (got["b"].mean, got["b"].low, got["b"].high) == (2.0, 2.0, 2.0)
    mean = sum(d for _, _, d in rows[:400]) / 400
    error = (sum((d - mean) ** 2 for _, _, d in rows[:400]) / 400) ** 0.5 / 20
    assert got["a"].mean == pytest.approx(mean)
    assert got["a"].low == pytest.approx(mean - 1.96 * error, abs=0.3 * error) and got["a"].high == pytest.approx(mean + 1.96 * error, abs=0.3 * error)


def test_paired(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("y", 1, 0.75), ("y", 2, 1.0)], "arm string, q int, v double")
    assert [tuple(r) for r in evaluation.paired(df, "arm", "q", "v", "x").collect()] == [("y", 1, 0.25)]
