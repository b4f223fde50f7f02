"""The positional index against the scans: words, phrases, OR, negation, cover density, with ties, nulls, long texts and few blocks read."""

import random

import pytest

from foliate.operators import ranking, search, textindex

QUERIES = ["alpha", "alpha beta", "alpha -beta", '"alpha beta" gamma', "alpha OR delta gamma", '-"beta alpha" alpha', '"alpha alpha"', "foo_bar", "zzz", "", "-alpha", "ÉTÉ alpha OR zzz", '"alpha beta gamma" OR delta -"delta delta"']


@pytest.fixture(scope="module")
def notes(spark):
    draw = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "été", "x", "y", "foo_bar", "q"]
    rows = [(k, draw.choice([None, "", "Alpha note", "beta alpha"]), " ".join(draw.choices(words, k=draw.choice([0, 1, 4, 30, 300])))) for k in range(700)]
    rows += [(1000, "alpha", None), (1001, None, "alpha beta " * 20_000), (1002, "gamma", "alpha, beta; gamma"), (1003, "", "alpha\nbeta")]
    return spark.createDataFrame(rows, "id long, title string, text string").repartition(4)


@pytest.fixture(scope="module")
def index(notes):
    return textindex.build(notes, "id", {"title": "A", "text": "D"}, block=16)


@pytest.mark.parametrize("query,limit", [(q, 5 if k % 3 else 2000) for k, q in enumerate(QUERIES)])
def test_keyword_equals_scan(notes, index, query, limit):
    want = [tuple(r) for r in search.keyword(notes, "id", query, limit, title="title").select("id", "match", "matched", "score").collect()]
    assert [tuple(r) for r in textindex.keyword(index, query, limit).select("id", "match", "matched", "score").collect()] == want


@pytest.mark.parametrize("units,limit", [(["alpha"], 40), (["alpha", "beta"], 3), (["gamma", "été", "Alpha"], 2000), (["gamma", "été", "Alpha"], 3), (["zzz", "alpha"], 3)])
def test_density_equals_scan(notes, index, monkeypatch, units, limit):
    monkeypatch.setattr(textindex, "FIRST", 2)
    want = ranking.density(notes, "id", units, {"title": 1.0, "text": 0.02}, limit).collect()
    assert textindex.density(index, units, limit).collect() == want


def test_few_blocks_are_read(notes, index, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST", 2)
    textindex.density(index, ["alpha", "beta"], 1).collect()
    assert index.read["read"] < index.read["blocks"] / 4
    textindex.keyword(index, '"foo bar" "alpha beta gamma delta"', 1).collect()
    assert index.read["first"] < index.read["blocks"]


def test_postings_are_whole(spark, index):
    [row] = index.postings(["beta"]).where("id = 1001").collect()
    assert row.tf == 20_000 and row.positions[:2] == [1 * 4 + 3, 3 * 4 + 3]


def test_index_of_nothing(spark, notes):
    empty = textindex.build(notes.limit(0), "id", {"text": "D"})
    assert textindex.keyword(empty, "alpha", 5).count() == 0 and textindex.density(empty, ["alpha"], 5).count() == 0


@pytest.mark.parametrize("query", ["alpha gamma", '"alpha beta" OR zzz', "alpha beta été", "alpha OR gamma delta -foo"])
def test_parts_that_match(spark, query):
    draw = random.Random(len(query))
    pick = lambda n: " ".join(draw.choices(["alpha", "beta", "gamma", "delta", "été", "x"], k=draw.randrange(n)))
    rows = [(k, pick(3), pick(3), pick(6)) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, title string, tags string, text string")
    index = textindex.build(df, "id", {"title": "A", "tags": "B", "text": "D"})
    found = textindex.keyword(index, query, 100)
    match = {r.id: r.match for r in found.collect()}
    got = {r.id: r.matched_in for r in textindex.matched_in(index, query, found, {"A": "title", "B": "tags", "D": "body"}).collect()}
    groups, _ = search.parse_query(query)

    def holds(row, names):
        texts = [f" {row[1 + ['title', 'tags', 'body'].index(n)]} " for n in names]
        has = [any(f" {' '.join(u)} " in t for u in g for t in texts) for g in groups]
        return all(has) if match[row[0]] == "all" else any(has)

    want = {}
    for row in rows:
        if row[0] in match:
            one = [n for n in ("title", "tags", "body") if holds(row, [n])]
            two = ["+".join(p) for p in (("title", "tags"), ("title", "body"), ("tags", "body")) if holds(row, p)]
            want[row[0]] = one or two[:1] or ["title+tags+body"]
    assert got == want


def test_two_fragments(spark, notes, index):
    units = ["alpha", "beta"]
    ids = [r.id for r in ranking.density(notes, "id", units, {"title": 1.0, "text": 0.02}, 60).collect()]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: [tuple(f) for f in r.fragments] for r in textindex.fragments(index, units, rows, 2, 3, 8).collect()}
    covers = {}
    for r in ranking.covers(notes.where(notes.id.isin(ids)), "id", units, {"title": 1.0, "text": 0.02}).collect():
        covers.setdefault(r.id, []).append(((max(r.begin - 2, 0), min(max(r.end - r.begin + 5, 3), 8)), (round(r.value, 9), -r.begin)))
    assert set(got) == set(covers) == set(ids)
    for i, own in covers.items():
        one = max(own, key=lambda c: c[1])[0]
        apart = [c for c in own if c[0][0] >= sum(one) or one[0] >= sum(c[0])]
        assert got[i] == sorted([one] + ([max(apart, key=lambda c: c[1])[0]] if apart else []))
    text = {r.id: r.excerpt for r in ranking.excerpts(notes, "id", textindex.fragments(index, units, rows), units, ["title", "text"]).collect()}
    assert all("<b>" in x for x in text.values()) and any(" … " in x for x in text.values())
