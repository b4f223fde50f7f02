"""Rules that say which rows are tasks, with three answers: true keeps, false drops, null is unsure, as what would tell was cut off or is pending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.operators.filters import under_any

ALL, FIELDS, FILTER = "all", "fields", "filter"


def told(test: Column, cut: Column) -> Column:
    """The answer of a test on a column that may be cut: what is found is there, what isn't may have been cut off."""
    return F.when(F.coalesce(test, F.lit(False)), True).when(F.coalesce(cut, F.lit(False)), F.lit(None).cast("boolean")).otherwise(False)


def usable(rule: dict) -> tuple[dict, str | None]:
    """(the rule in force, why a rule can't be: unknown, no_filter): one that can't be is the rule that keeps all."""
    kind = rule.get("kind", ALL)
    if "any" in rule or "every" in rule or "no" in rule:
        return rule, None
    if kind not in (ALL, FIELDS, FILTER):
        return {"kind": ALL}, "unknown"
    if kind == FILTER and not str(rule.get("text") or "").strip():
        return {"kind": ALL}, "no_filter"
    return rule, None


def compiled(rule: dict, fields: list[str], text: str = "text", text_cut: str = "text_cut", tags: str = "tags", tags_cut: str = "tags_cut", pending: Column | None = None, signs: str = "") -> Column:
    """A rule as a column of three answers, by Spark's own logic of true, false and null.

    {"kind": "all"} keeps; "fields" keeps rows with one of the field columns, or a tag equal to or below one of rule["tags"] (unsure where tags
    are cut and none is seen); "filter" keeps texts that hold rule["text"] (unsure where the text is cut). {"any": [...]}, {"every": [...]} and
    {"no": rule} combine rules: an unsure part matters only if the others leave the answer open. Rows that are `pending` have no field
    columns yet and are judged by the signs in their text. A rule that can't be used keeps all; see usable().
    """
    rule, _ = usable(rule)
    part = lambda r: compiled(r, fields, text, text_cut, tags, tags_cut, pending, signs)
    if "any" in rule:
        return reduce(lambda a, b: a | b, map(part, rule["any"]), F.lit(False))
    if "every" in rule:
        return reduce(lambda a, b: a & b, map(part, rule["every"]), F.lit(True))
    if "no" in rule:
        return ~part(rule["no"])
    if rule.get("kind", ALL) == FIELDS:
        has = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in fields), F.lit(False))
        if pending is not None and signs:
            signed = F.translate(F.coalesce(F.col(text), F.lit("")), signs, "") != F.coalesce(F.col(text), F.lit(""))
            has = has | (F.coalesce(pending, F.lit(False)) & signed)
        wanted = list(dict.fromkeys(t.strip().strip("#/").lower() for t in rule.get("tags") or () if t.strip("#/ ")))
        return has | told(under_any(F.col(tags), wanted), F.col(tags_cut)) if wanted else has
    if rule.get("kind") == FILTER:
        return told(F.contains(F.col(text), F.lit(rule["text"])), F.col(text_cut))
    return F.lit(True)


def side_counts(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row for groups of three-valued predicates: kept (no group drops the row), unsure (kept, but some group is), and without_<name>:
    rows that the group alone drops. One pass, whatever the number of groups."""
    names = {name: f"_{k}" for k, name in enumerate(groups)}
    answers = rows.select(*[c.alias(names[n]) for n, c in groups.items()])
    drops = {n: F.coalesce(~F.col(c), F.lit(False)) for n, c in names.items()}
    dropped = reduce(lambda a, b: a + b, (d.cast("int") for d in drops.values()), F.lit(0))
    open_ = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in names.values()), F.lit(False))
    return answers.agg(F.count_if(dropped == 0).alias("kept"), F.count_if((dropped == 0) & open_).alias("unsure"), *[F.count_if((dropped == 1) & d).alias(f"without_{n}") for n, d in drops.items()])
