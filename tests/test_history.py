"""Version history and upkeep at their edges, against plain versions."""

import fnmatch
import random

import pytest

from foliate.operators import history, upkeep


def test_commits_of_odd_records(spark):
    head = "c1\x1f2024-02-03T04:05:06\x1fann\x1ffirst"
    records = [(f"{head}\nA\ta b.md\nR100\told.md\tnew.md\nM\nR100\tx.md\n\nnothing",), ("no header\nA\ta.md",), (head,), ("",), (None,)]
    got = history.commits(spark.createDataFrame(records, "r string"), "r").collect()
    assert sorted((r.commit, r.status, r.path, r.from_path) for r in got) == [("c1", "A", "a b.md", None), ("c1", "R", "new.md", "old.md")]
    assert {str(r.at) for r in got} == {"2024-02-03 04:05:06"}
    assert history.commits(spark.createDataFrame([("c\x1fno time\x1fann\x1fs\nM\ta",)], "r string"), "r").first().at is None


def _roots(changes):
    """One change after the other: the birth each path descends from."""
    birth, out = {}, {}
    for at, status, path, old in sorted(changes):
        if status == "R":
            birth[path] = birth.get(old, (path, at)) if old is not None else (path, at)
        elif status in "AC":
            birth[path] = (path, at)
        out[at] = birth.get(path, (path, None))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_lineages_equal_one_change_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    changes = [(t, rng.choice("AMMRRRRC"), rng.choice(names), rng.choice([*names, None])) for t in range(80)]
    df = spark.createDataFrame(changes, "at int, status string, path string, from_path string")
    got = {r.at: (r.root_path, r.root_at) for r in history.lineages(df.repartition(5)).collect()}
    assert got == _roots(changes)


def test_lineages_of_a_long_chain_and_of_nothing(spark):
    schema = "at int, status string, path string, from_path string"
    chain = [(0, "A", "p0", None)] + [(k, "R", f"p{k}", f"p{k - 1}") for k in range(1, 40)] + [(50, "M", "p39", None), (51, "M", None, None)]
    got = {r.at: (r.root_path, r.root_at) for r in history.lineages(spark.createDataFrame(chain, schema)).collect()}
    assert got == {t: ("p0", 0) for t in [*range(40), 50]}
    assert history.lineages(spark.createDataFrame([], schema)).count() == 0


def _origins(versions):
    out = {}
    for path in {p for p, _, _ in versions}:
        mine = sorted((at, (body or "").split("\n")) for p, at, body in versions if p == path)
        for k, text in enumerate(mine[-1][1]):
            nth, since = mine[-1][1][: k + 1].count(text), None
            for at, lines in reversed(mine):
                if lines.count(text) < nth:
                    break
                since = at
            out[path, k] = (text, since)
    return out


def test_line_origins_equal_a_walk_back(spark):
    rng = random.Random(3)
    versions = [(p, at, None if rng.random() < 0.1 else "\n".join(rng.choice(["x", "y", "z", ""]) for _ in range(rng.randrange(5)))) for p in "ab" for at in range(9)]
    df = spark.createDataFrame(versions, "p string, at int, body string")
    got = {(r.path, r.line): (r.text, r.since) for r in history.line_origins(df, "p", "at", "body").collect()}
    assert got == _origins(versions)


@pytest.mark.parametrize("glob", ["*.md", "a?c", "[ab]*", "[!ab]*", "[^a]", "a.b", "x[1-3]", "[", "a+(b)", "*\\*"])
def test_globs_equal_fnmatch(spark, glob):
    names = ["a.md", "abc", "b/c.md", "axb", "a.b", "x2", "x4", "[", "^", "a", "a+(b)", "q\\z", "a\nc", ""]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "p string")
    got = {r.p for r in df.where(history.matches_any(df.p, [glob])).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n, glob)}


def test_listing_stops_at_its_folder_and_limit(spark):
    files = spark.createDataFrame([("a/1.md",), ("a/2.md",), ("a/b/3.md",), ("ab/4.md",), (None,)], "f string")
    rows = lambda *args: [tuple(r) for r in history.listed(files, "f", "a/", "*.md", *args).orderBy("path").collect()]
    assert rows(False, 9) == [("a/1.md", False), ("a/2.md", False)]
    assert rows(True, 2) == [("a/1.md", True), ("a/2.md", True)]
    assert rows(True, 3) == [("a/1.md", False), ("a/2.md", False), ("a/b/3.md", False)]
    assert history.listed(files, "f", "zz/", "*", True, 3).count() == 0


def test_relationships_roots_and_rotation(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (1, 4), (2, None), (None, 5)], "src int, dst int")
    got = sorted(tuple(r) for r in upkeep.relationships(edges, 2).collect())
    assert got == [(1, "out", 2, True), (1, "out", 3, True), (2, "in", 1, False), (3, "in", 1, False), (4, "in", 1, False)]
    roots = spark.createDataFrame([(1, "/v/a"), (2, "/v/a/"), (3, "/v/a/b"), (4, "/v/ab"), (5, None)], "id int, p string")
    assert sorted(tuple(r) for r in upkeep.overlapping(roots, "id", "p").collect()) == [(1, 2, "same"), (3, 1, "below"), (3, 2, "below")]
    owners = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.id for r in upkeep.rotated(owners, "id", 2).orderBy("place").collect()] == [3, 1, 2]
    assert [r.id for r in upkeep.rotated(owners, "id", None).orderBy("place").collect()] == [1, 2, 3]
