"""Three-valued rules against a reading of every way in which what was cut may go on."""

import itertools

from pyspark.sql import functions as F

from foliate.operators import rules

ROWS = [(k, d, t, tc, tags, gc, p) for k, (d, t, tc, tags, gc, p) in enumerate(itertools.product([None, "2024-01-01"], ["buy milk", "buy", None, "📅 x"], [True, False, None], [["a/b", "c"], [], None], [True, False], [True, False]))]


def ways(row, rule):
    """All answers that a rule can give if cut texts and tags go on in some way."""
    _, due, text, text_cut, tags, tags_cut, pending = row
    out = set()
    for more_text in (["", " milk", " buy"] if text_cut else [""]):
        for more_tags in ([[], ["a"]] if tags_cut else [[]]):
            out.add(plain(rule, due, (text or "") + more_text, text or "", [*(tags or []), *more_tags], pending))
    return out


def plain(rule, due, text, seen, tags, pending):
    sub = lambda r: plain(r, due, text, seen, tags, pending)
    if "any" in rule:
        return any(map(sub, rule["any"]))
    if "every" in rule:
        return all(map(sub, rule["every"]))
    if "no" in rule:
        return not sub(rule["no"])
    if rule["kind"] == "fields":
        under = any(t == w or t.startswith(w + "/") for t in tags for w in rule.get("tags", []))
        return due is not None or (pending and "📅" in seen) or under
    return rule["text"] in text if rule["kind"] == "filter" else True


def test_rules(spark):
    df = spark.createDataFrame(ROWS, "k int, due string, text string, text_cut boolean, tags array<string>, tags_cut boolean, pending boolean")
    fields, milk = {"kind": "fields", "tags": ["a"]}, {"kind": "filter", "text": "milk"}
    every = [fields, {"kind": "fields"}, milk, {"kind": "all"}, {"any": [fields, milk]}, {"every": [fields, milk]}, {"no": milk}, {"any": [{"no": fields}, {"kind": "filter", "text": "buy"}]}]
    made = df.select("k", *[rules.compiled(r, ["due"], pending=F.col("pending"), signs="📅").alias(f"r{n}") for n, r in enumerate(every)])
    for row, got in zip(ROWS, sorted(made.collect()), strict=True):
        for n, rule in enumerate(every):
            can = ways(row, rule)
            assert got[f"r{n}"] == (None if len(can) == 2 else can.pop()), (row, rule)


def test_rules_that_cannot_be_used(spark):
    assert rules.usable({"kind": "nonsense"}) == ({"kind": "all"}, "unknown") and rules.usable({"kind": "filter", "text": " "})[1] == "no_filter" and rules.usable({"kind": "filter", "text": "x"})[1] is None
    df = spark.createDataFrame(ROWS, "k int, due string, text string, text_cut boolean, tags array<string>, tags_cut boolean, pending boolean")
    assert df.where(~rules.compiled({"kind": "filter"}, ["due"])).count() == 0


def test_side_counts(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True), (None, False), (False, True), (None, None)], "a boolean, b boolean")
    assert rules.side_counts(df, {"a": F.col("a"), "b": F.col("b")}).collect()[0].asDict() == {"kept": 3, "unsure": 2, "without_a": 1, "without_b": 2}
    assert tuple(rules.side_counts(df.limit(0), {"a": F.col("a")}).collect()[0]) == (0, 0, 0)
