"""Operators on small tables by hand."""

import datetime as dt

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.functions import text as paths
from foliate.jobs import registry
from foliate.operators import feed, filters, graph, parsing, search, tasks, usage
from foliate.sources import readers
from foliate.streaming import events
from tests.conftest import SMALL
from tests.oracle import rows as sorted_rows


def test_markdown():
    note = parsing.parse("---\ntags: [a, b/c]\ntitle: X\n---\n# One #\nsee [[Hub|home]] and ![[pic.png]] `[[no]]` #tag #123 #fff0\n```\n#code [[no]]\n```\n## Two\n- [x] done \U0001f4c5 2024-01-02\n- [ ] [open](b.md)\n%% #hidden %%\n")
    assert note["tags"] == ["a", "b/c", "fff0", "tag"]
    assert note["links"] == [("link", "Hub"), ("embed", "pic.png"), ("markdown", "b.md")]
    assert note["headings"] == [(1, "One", 0), (2, "Two", 5)]
    assert [t[1:] for t in note["tasks"]] == [("done", "done \U0001f4c5 2024-01-02", "2024-01-02", "One > Two"), ("open", "[open](b.md)", None, "One > Two")]


def test_broken_front_matter_is_body():
    assert parsing.partition("---\nno colon here!\n---\nx")[0] == {}
    assert parsing.partition("---\na: 1\n")[1] == "---\na: 1\n"



def test_recurrence(spark):
    day = dt.date(2021, 1, 31)
    df = spark.createDataFrame([("every month", day), ("every 2 weeks", day), ("sometimes", day), (None, day)], "rule string, due date")
    out = df.select(tasks.next_occurrence(F.col("rule"), F.col("due"), F.lit(None).cast("date"), F.lit(None).cast("date"))["due"]).collect()
    assert [r[0] for r in out] == [dt.date(2021, 2, 28), dt.date(2021, 2, 14), None, None]


def test_owner_and_validity(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, dt.datetime(2024, 1, 2)), (None, dt.datetime(2024, 1, 2), None)], "owner int, valid_from timestamp, valid_to timestamp")
    assert df.where(filters.owned("owner", None)).count() == 2
    assert df.where(filters.valid_at("2024-01-02")).count() == 2
    assert df.where(filters.current()).count() == 2


def test_json_types(spark):
    df = spark.createDataFrame([('{"a": 1, "t": ["x", "y"]}',), ('{"a": "1"}',), ('{"a": 1.0}',), (None,), ("no",)], "j string")
    assert [r[0] for r in df.where(filters.contains_json("j", {"a": 1})).collect()] == ['{"a": 1, "t": ["x", "y"]}', '{"a": 1.0}']
    assert df.where(filters.contains_json("j", {"a": "1"})).count() == 1
    assert df.where(filters.contains_json("j", {"t": ["y"]})).count() == 1


def test_pages_partition_the_list(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 5, i) for i in range(40)], "a int, b int")
    keys, got, at = [("a", True), ("b", False)], [], None
    while True:
        rows = [tuple(r) for r in filters.page(df, keys, 9, at).collect()]
        got += rows[:9]
        if len(rows) <= 9:
            break
        at = list(rows[8])
    assert got == sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])) and len(set(got)) == 40


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, p string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, p string, rank int")
    one, two = (sorted(map(tuple, search.fused(arms, ["q", "p"]).collect())) for arms in ([a, b], [b, a]))
    assert one == two and [r[1] for r in sorted(one, key=lambda r: r[-1])] == ["y", "x", "z"]


def test_confidence(spark):
    rows = spark.createDataFrame([(True, 0.1), (False, 0.5), (False, 0.4), (False, None)], "a boolean, s double")
    assert [r[0] for r in rows.select(search.confidence(F.col("a"), F.col("s"), 0.5)).collect()] == ["ok", "ok", "low", "low"]


def test_snapshot_moves(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "p string, h string")
    after = spark.createDataFrame([("x", "1"), ("y", "2"), ("d", "4")], "p string, h string")
    got = sorted((r.kind, r.path) for r in feed.snapshot_diff(before, after, "p", "h").collect())
    assert got == [("create", "y"), ("delete", "b"), ("delete", "c"), ("modify", "d"), ("move", "x")]


def test_newest_event_stays(spark):
    e = spark.createDataFrame([(1, 1, dt.datetime(2020, 1, 1)), (1, 2, dt.datetime(2020, 1, 2))], "u int, seq int, at timestamp")
    assert [r.seq for r in feed.retained(e, "u", "seq", "at", "2024-01-01", 10).collect()] == [2]


def test_resolution_order(spark):
    notes = spark.createDataFrame([(1, "a/Hub.md"), (2, "Hub.md"), (3, "b/Own.md")], "id int, p string")
    edges = spark.createDataFrame([("", "a/Hub.md"), ("b", "Own.md"), ("z", "Hub"), ("z", "None")], "folder string, target string")
    assert sorted((r.target, r.dst) for r in graph.resolved(edges, notes, "id", "p").collect()) == [("Hub", 2), ("None", None), ("Own.md", 3), ("a/Hub.md", 1)]


def test_markdown_tree_and_export(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "n").mkdir()
    for name, data in (("n/a.md", b"x\r\ny"), (".git/b.md", b"no"), ("c.txt", b"no"), ("bad.md", b"\xff\xfe")):
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.text for r in readers.markdown_tree(spark, str(tmp_path)).collect()}
    assert got == {"n/a.md": "x\ny", "bad.md": None}
    rows, bad = readers.load_export(spark.createDataFrame([('{"id": 1}',), ("{oops",)], "value string"), "id bigint")
    assert rows.collect()[0].id == 1 and bad.first().malformed == 1


def test_url_target(spark):
    assert spark.range(1).select(paths.url_target(F.lit("a%20b+c")), paths.stem_of(F.lit("x/y.md")), paths.folder_of(F.lit("x/y.md"))).first()[0:3] == ("a b+c", "y", "x")


def test_token_bucket(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 0, 0, 5)]
    spark.createDataFrame(rows, "k int, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, t timestamp").parquet(f"{tmp_path}/in")
    q = events.token_bucket(stream, "k", "t", 0.2, 2).writeStream.format("memory").queryName("bucket").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.admitted for r in spark.sql("SELECT * FROM bucket ORDER BY t, admitted DESC").collect()] == [True, True, False, True]


@pytest.mark.parametrize("name", ["stream_minute_counts", "stream_sequence"])
def test_streams_over_many_files_out_of_time_order(spark, tmp_path, name):
    source = spark.read.parquet(f"{SMALL}/events.parquet")
    source.repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) > 16
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SMALL}/events.parquet')")
    out = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(tmp_path))
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows([d[0] for d in out.description], out.fetchall())


def test_words_with_underscores_are_found(spark):
    df = spark.createDataFrame([(1, "call foo_bar now"), (2, "foo"), (3, "bar foo")], "id int, text string")
    assert [(r.id, r.match) for r in search.keyword(df, "id", "foo_bar", 5).collect()] == [(1, "all")]


def test_large_whole_numbers_in_json(spark):
    df = spark.createDataFrame([('{"n": 9007199254740992}',), ('{"n": 9007199254740993}',), ('{"n": 9007199254740993.0}',), ('{"n": "9007199254740993"}',), ('{"n": 1.5}',), ('{"n": 7e0}',)], "data string")
    found = lambda n: [r.data for r in df.where(filters.contains_json("data", {"n": n})).collect()]
    assert found(9007199254740993) == ['{"n": 9007199254740993}', '{"n": 9007199254740993.0}']
    assert found(1.5) == ['{"n": 1.5}'] and found(7) == ['{"n": 7e0}'] == found(7.0)


def test_neighbourhood_five_steps_away(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(2, 7), (None, 1), (3, None)], "a long, b long")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r.node: (r.distance, r.via) for r in graph.neighbourhood(edges, start, 5).collect()}
    assert got == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (3, 2), 7: (3, 2), 4: (4, 3), 6: (4, 7), 8: (4, 7), 5: (5, 4)}
    scans = graph.neighbourhood(edges, start, 6)._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans <= 8


def test_notes_with_one_path_resolve_to_the_least_id(spark):
    notes = spark.createDataFrame([(5, "b/Plan.md"), (3, "b/Plan.md")], "id long, path string")
    edges = spark.createDataFrame([("", "Plan")], "folder string, target string")
    assert graph.resolved(edges, notes, "id", "path").collect()[0].dst == 3


def test_percentiles_by_ranks(spark):
    import random

    draw = random.Random(9)
    rows = [(k, draw.choice([None, "x"]), v) for k in ("a", "b", None) for v in [draw.choice([None, 0.0, -3.5, 1e-9, 7.0, 7.25, 1e12, draw.gauss(50, 9), draw.gauss(50, 9)]) for _ in range(draw.randrange(1, 120))]] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "k string, l string, v double")
    got = {(r.k, r.l): (r.p0, r.p50, r.p99) for r in usage.percentiles(df, ["k", "l"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted(r[2] for r in rows if r[:2] == key and r[2] is not None)
        if own:
            at = lambda q: (own[int(q * (len(own) - 1))], own[min(int(q * (len(own) - 1)) + 1, len(own) - 1)], q * (len(own) - 1) % 1)  # noqa: E731, B023
            want[key] = tuple(pytest.approx(a + (b - a) * f) for a, b, f in map(at, (0.0, 0.5, 0.99)))
    assert got == want
    assert usage.percentiles(df.limit(0), ["k"], "v", {"p": 0.5}).count() == 0


def test_similar_descriptions_equal_all_pairs(spark):
    import random

    draw = random.Random(8)
    sets = [sorted(set(draw.choices("aaabbcdefghij", k=draw.randrange(6)))) for _ in range(60)]
    left, right = [(k, s) for k, s in enumerate(sets[:30])], [(k, s) for k, s in enumerate(sets[30:])]
    got = {(r.a, r.b): (r.containment, r.jaccard) for r in tasks.similar_descriptions(spark.createDataFrame(left, "a int, terms array<string>"), spark.createDataFrame(right, "b int, terms array<string>"), 0.6).collect()}
    want = {}
    for a, s in left:
        for b, t in right:
            n = len(set(s) & set(t))
            if n and n / min(len(s), len(t)) >= 0.6:
                want[a, b] = (pytest.approx(n / min(len(s), len(t))), pytest.approx(n / len(set(s) | set(t))))
    assert got == want


def test_rotation_over_ranges(spark):
    from foliate.operators import upkeep

    df = spark.createDataFrame([(k,) for k in range(100)], "id long").repartition(5)
    assert [r.id for r in upkeep.rotated(df, "id", 40).orderBy("place").collect()] == [*range(41, 100), *range(41)]
    assert [r.place for r in upkeep.rotated(df, "id", None).orderBy("id").collect()] == list(range(1, 101)) and upkeep.rotated(df.limit(0), "id", 3).count() == 0


def test_hybrid_gives_a_note_one_place(spark):
    notes = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha beta")], "id int, text string")
    chunks = spark.createDataFrame([(2, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (3, [0.1, 1.0])], "id int, v array<double>")
    ask = lambda like: search.hybrid(notes, chunks, F.lit(True), "id", "text", "v", "alpha", like, 9).orderBy("place").collect()
    assert {(r.id, r.vector_rank) for r in ask([1.0, 0.0])} == {(1, None), (2, 1), (3, 2)}
    assert [(r.id, r.matched_in) for r in ask(None)] == [(1, "keyword"), (3, "keyword")]
