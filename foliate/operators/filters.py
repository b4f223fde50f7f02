"""Predicates and paging, composed as expressions over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned(column: str, owner: object) -> Column:
    """Rows of one owner; None is an owner of its own, not 'any'."""
    return F.col(column).eqNullSafe(F.lit(owner))


def in_folder(path: str, folder: str) -> Column:
    """Paths below a folder, without pattern characters."""
    return F.col(path).startswith(folder)


def has_tags(tags: str, wanted: list[str]) -> Column:
    """All of the tags; rows without tags never match."""
    return reduce(lambda a, t: a & F.coalesce(F.array_contains(tags, t), F.lit(False)), wanted, F.lit(True))


def contains_json(column: str, wanted: dict) -> Column:
    """JSON containment of a literal object: scalars of the same type and value at every depth, nested objects, arrays of which each element is found.

    A key may have either kind of quotation mark, not both: a path can't name such a one.
    """

    def holds(value: Column, want: object) -> Column:
        kind = F.schema_of_variant(value)
        if isinstance(want, dict):
            at = {k: f"$['{k}']" if "'" not in k else f'$["{k}"]' for k in want}
            inside = [holds(F.try_variant_get(value, at[k], "variant"), w) for k, w in want.items()]
            return reduce(lambda a, b: a & b, inside, kind.startswith("OBJECT"))
        if isinstance(want, list):
            items = F.try_variant_get(value, "$", "array<variant>")
            return reduce(lambda a, w: a & F.exists(items, lambda x: holds(x, w)), want, kind.startswith("ARRAY"))
        if want is None:
            return F.is_variant_null(value)
        if isinstance(want, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == want)
        if isinstance(want, int) or isinstance(want, float) and want.is_integer() and abs(want) < 10**37:
            # whole numbers are compared digit by digit: doubles are exact to 2^53 only
            exact = F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(int(want))).try_cast("decimal(38,0)")
            near = F.try_variant_get(value, "$", "double") == float(want)
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & near & F.when(kind == "DOUBLE", True).otherwise(F.coalesce(exact, F.lit(False)))
        if isinstance(want, float):
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(value, "$", "double") == want)
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == want)

    return F.coalesce(holds(F.try_parse_json(F.col(column)), wanted), F.lit(False))


def under_none(tags: Column, wanted: list[str]) -> Column:
    """No tag equal to or below one of those; rows without tags match."""
    return ~under_any(tags, wanted)


def under_all(tags: Column, wanted: list[str]) -> Column:
    """Of every wanted tag one equal to or below it; rows without tags never match."""
    return reduce(lambda a, w: a & under_any(tags, [w]), wanted, F.lit(True))


def has_words(folded: Column, words: list[str]) -> Column:
    """All of the words somewhere in a folded text."""
    return reduce(lambda a, w: a & F.contains(folded, F.lit(w.lower())), words, F.lit(True))


def in_range(day: Column, first: str | None, last: str | None) -> Column:
    """Days from `first` to `last`, both included; rows without a day match only without bounds."""
    out = F.lit(True)
    for bound, ok in ((first, lambda b: day >= b), (last, lambda b: day <= b)):
        if bound is not None:
            out = out & F.coalesce(ok(F.lit(bound).cast("date")), F.lit(False))
    return out


def one_of(value: Column, wanted: list[str | None]) -> Column:
    """A value of a set, in which None stands for rows without one."""
    named = [w for w in wanted if w is not None]
    return F.coalesce(value.isin(named), F.lit(False)) | (value.isNull() if None in wanted else F.lit(False))


def current(valid_to: str = "valid_to") -> Column:
    """What holds now: an absent time means the present, never everything."""
    return F.col(valid_to).isNull()


def valid_at(when: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Half-open validity; a null bound is unbounded."""
    t = F.lit(when).cast("timestamp")
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= t)) & (F.col(valid_to).isNull() | (F.col(valid_to) > t))


def stale(embedded: str, content: str) -> Column:
    """A stored hash that isn't the content's; null is stale."""
    return ~F.col(embedded).eqNullSafe(F.col(content))


def tag_prefixes(tags: Column) -> Column:
    """Every tag and all it lies under: a/b/c gives a, a/b, a/b/c; lower case, sorted, once each."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.size(F.split(t, "/"))), lambda i: F.array_join(F.slice(F.split(t, "/"), 1, i), "/"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tags, lambda t: cut(F.lower(F.trim(t)))))))


def under_any(tags: Column, wanted: list[str]) -> Column:
    """A tag equal to or below one of those wanted: a matches A and a/b, not ab."""
    return F.coalesce(F.exists(tags, lambda t: reduce(lambda a, w: a | (F.lower(t) == w.lower()) | F.lower(t).startswith(w.lower() + "/"), wanted, F.lit(False))), F.lit(False))


def all_terms(text: str, terms: list[str]) -> Column:
    """Every term is somewhere in the text."""
    return reduce(lambda a, t: a & (F.instr(text, t) > 0), terms, F.lit(True))


def after(keys: list[tuple[str, bool]], boundary: list[object]) -> Column:
    """Rows after a boundary in the order of (column, descending) keys, expanded to comparisons of one column each; nulls come last."""
    out, equal = F.lit(False), F.lit(True)
    for (name, down), at in zip(keys, boundary, strict=True):
        c = F.col(name)
        if at is None:
            beyond = F.lit(False)
        else:
            beyond = (c < F.lit(at) if down else c > F.lit(at)) | c.isNull()
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & c.eqNullSafe(F.lit(at))
    return out


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, boundary: list[object] | None = None) -> DataFrame:
    """A page by keyset: size + 1 rows, of which the last only says that there is more."""
    rows = df.where(after(keys, boundary)) if boundary else df
    return rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]).limit(size + 1)


def fitting(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Of each group the longest prefix in order whose sizes fit the budget."""
    from pyspark.sql import Window

    total = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= budget)
