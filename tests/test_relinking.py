"""Links kept up to date against links resolved anew, after random moves, additions, deletions and new names."""

import random

import pytest

from foliate.operators import graph


@pytest.mark.parametrize("seed", [1, 2])
def test_relinked_equals_resolved_anew(spark, seed):
    draw = random.Random(seed)
    names, folders = ["Plan", "plan", "Home", "x.y", "Ünï", "deep"], ["", "a/", "a/b/", "c/"]
    path = lambda: draw.choice(folders) + draw.choice(names) + ".md"
    notes = {k: path() for k in range(12)}
    aliases = {(k, draw.choice(["the plan", "HOME", "y", "Deep "])) for k in range(0, 12, 3)}
    target = lambda: draw.choice([draw.choice(names), path(), path()[:-3], "../" + draw.choice(names), "./b/" + draw.choice(names), "the plan", "deep", "nowhere", "", None])
    edges = [(draw.choice(list(notes.values())), target(), k) for k in range(80)]

    def tables():
        return (
            spark.createDataFrame(edges, "source string, target string, k long"),
            spark.createDataFrame(list(notes.items()), "id long, path string"),
            spark.createDataFrame(list(aliases) or [(0, None)], "id long, alias string"),
        )

    links = graph.linked(*tables())
    for step in range(3):
        if step == 1:  # an edge is added, another source moves
            edges += [("c/New.md", target(), 100 + step), ("a/b/New.md", "Plan", 200 + step)]
        for _ in range(step):
            k = draw.randrange(15)
            if draw.random() < 0.3:
                notes.pop(k, None)
            else:
                notes[k] = path()
            aliases ^= {(draw.randrange(12), draw.choice(["the plan", "y"]))}
        now = tables()
        links = graph.relinked(links, *now)
        want = {(r.k, r.dst) for r in graph.resolved_by_all_rules(*now).collect()}
        got = links.edges(now[0]).collect()
        assert {(r.k, r.dst) for r in got} == want and len(got) == len(edges)
        assert links.recomputed == 0 if step == 0 else links.recomputed <= links.asks


def test_only_touched_links_are_resolved_again(spark):
    notes = [(k, f"f{k}/n{k}.md") for k in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, path string")
    edges = spark.createDataFrame([(f"f{k}/n{k}.md", f"n{(k + 1) % 50}") for k in range(50)], "source string, target string")
    none = spark.createDataFrame([], "id long, alias string")
    links = graph.linked(edges, frame(notes), none)
    links = graph.relinked(links, edges, frame([(0, "z/n7.md"), *notes[1:]]), none)
    assert (links.recomputed, links.asks) == (2, 50)
