"""Tasks: listing with side counts, agenda, orders, recurrence, duplicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.session import ship

#: Ranks of priorities; none lies between medium and low.
RANKS = {"highest": 0, "high": 1, "medium": 2, "low": 4, "lowest": 5}
CAPS = {"overdue": 25, "today": 25, "scheduled": 15, "later": 15, "upcoming": 50}


def priority_rank(priority: Column) -> Column:
    """The rank of a priority; anything else counts as none."""
    rank = F.lit(3)
    for name, n in RANKS.items():
        rank = F.when(priority == name, n).otherwise(rank)
    return rank


def task_key(text: Column, tag: str) -> Column:
    """Identity of a task line: the first 12 digits of the SHA-256 of tag, a zero byte and text; tag names who stores the tasks."""
    return F.substring(F.sha2(F.concat(F.encode(F.lit(tag), "utf-8"), F.unhex(F.lit("00")), F.encode(text, "utf-8")), 256), 1, 12)


def with_ordinals(tasks: DataFrame, note: str, key: str, line: str) -> DataFrame:
    """Ordinal and count of equal keys within a note."""
    w = Window.partitionBy(note, key)
    return tasks.withColumns({"key_ordinal": F.row_number().over(w.orderBy(line)), "key_count": F.count("*").over(w)})


def side_counts(tasks: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """For each group of predicates the rows that all other groups keep and it alone leaves out, in one pass, and the rows that all keep."""
    kept = lambda but: [c for name, c in groups.items() if name != but]
    every = lambda cs: F.coalesce(F.array_min(F.array(*[c.cast("int") for c in cs])), F.lit(0)) == 1 if cs else F.lit(True)
    return tasks.agg(F.count_if(every(kept(None))).alias("kept"), *[F.count_if(every(kept(n)) & ~F.coalesce(c, F.lit(False))).alias(f"without_{n}") for n, c in groups.items()])


def section(due: Column, scheduled: Column, day: Column, days: int) -> Column:
    """The one agenda section of an open task, or null."""
    until = F.date_add(day, days)
    return (
        F.when(due < day, "overdue").when(due == day, "today")
        .when((due > day) & (due <= until), "upcoming")
        .when((scheduled <= day) & due.isNull(), "scheduled")
        .when((scheduled <= day) & (due > until), "later")
    )


def agenda(tasks: DataFrame, due: str, scheduled: str, day: str, days: int, order: list[str], caps: dict[str, int] = CAPS) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): the first tasks of each section up to its cap, and the size of every section from one pass."""
    rows = tasks.withColumn("section", section(F.col(due), F.col(scheduled), F.lit(day).cast("date"), days)).where("section IS NOT NULL")
    totals = rows.groupBy("section").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(*order))
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("section") == name, n).otherwise(cap)
    return rows.withColumn("place", rank).where(F.col("place") <= cap), totals


def next_occurrence(rule: Column, due: Column, scheduled: Column, start: Column, done: Column | None = None, strict: bool = False) -> Column:
    """The dates of the next occurrence: the first of due, scheduled, start moves by the rule and the others by as many days.

    A rule 'when done' counts from the day `done`, and without one from the date that moves.
    """
    parsed = recurrence(rule, strict)
    anchor = F.coalesce(due, scheduled, start)
    begin = anchor if done is None else F.when(parsed["when_done"], F.coalesce(done, anchor)).otherwise(anchor)
    shift = F.datediff(next_by_rule(parsed, begin, strict), anchor)
    return once(shift, lambda days: F.struct(*[F.date_add(d, days).alias(name) for name, d in (("due", due), ("scheduled", scheduled), ("start", start))]))


def similar_descriptions(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, containment, jaccard) of term sets left(a, terms) and right(b, terms) that share a term, at or over the threshold by either.

    Either measure is at most what is common by the smaller set. So of two sets that reach the threshold, the rarest words of the smaller
    one, all but ceil(threshold n) - 1 of its n, have one in common with the other: pairs come only from these words of each side met with
    all words of the other side, which leaves out frequent words; what is common is then counted on the sets themselves.
    """
    l, r = (df.select(i, F.array_distinct("terms").alias("t")).where(F.size("t") > 0) for df, i in ((left, "a"), (right, "b")))  # noqa: E741
    words = l.select("a", F.explode("t").alias("w")).select("w").union(r.select("b", F.explode("t").alias("w")).select("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, i: str) -> DataFrame:
        each = df.select(i, F.explode("t").alias("w")).join(words, "w").groupBy(i).agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("s"))
        keep = F.size("s") - F.ceil(F.lit(threshold) * F.size("s") - 1e-9).cast("int") + 1
        return each.select(i, F.explode(F.slice("s", 1, F.greatest(F.lit(1), F.least(keep, F.size("s"))))).alias("x")).select(i, "x.w")

    every = lambda df, i: df.select(i, F.explode("t").alias("w"))
    pairs = rarest(l, "a").join(every(r, "b"), "w").select("a", "b").union(rarest(r, "b").join(every(l, "a"), "w").select("a", "b")).distinct()
    both = pairs.join(l.withColumnRenamed("t", "ta"), "a").join(r.withColumnRenamed("t", "tb"), "b")
    met = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("s"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
    out = met.withColumns({"containment": F.col("s") / F.least("na", "nb"), "jaccard": F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))})
    return out.where(F.greatest("containment", "jaccard") >= threshold).select("a", "b", "containment", "jaccard")


#: The signs of a task line's fields and priorities, and the names in recurrence rules.
DATE_SIGNS = {"due": "📅📆🗓", "scheduled": "⏳⌛", "start": "🛫", "created": "➕", "done": "✅", "cancelled": "❌"}
PRIORITY_SIGNS = {"🔺": "highest", "⏫": "high", "🔼": "medium", "🔽": "low", "⏬": "lowest"}
REPEAT_SIGN, OTHER_SIGNS = "🔁", "🏁🆔⛔"
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
UNITS = ["day", "week", "month", "year"]
RULE_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789, !"
WHEN_DONE = " when done"


def fields(text: Column) -> Column:
    """The fields of a task line: six dates, priority, recurrence rule, tags.

    Of a field that comes several times the last counts; a last one without a valid date has none. A rule ends at the next sign or tag.
    """
    last = lambda pattern: F.nullif(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1)), F.lit(""))
    dates = [F.try_to_date(last(f"[{signs}]️?\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})?"), "yyyy-MM-dd").alias(name) for name, signs in DATE_SIGNS.items()]
    signs = "".join([*DATE_SIGNS.values(), *PRIORITY_SIGNS, REPEAT_SIGN, OTHER_SIGNS])
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY_SIGNS.items() for x in pair])
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|(?<=\s))#([\p{L}\p{N}_/\-]+)"), 1))
    rule = F.nullif(F.trim(last(f"{REPEAT_SIGN}️?([^{signs}#]*)")), F.lit(""))
    return F.struct(*dates, F.try_element_at(rank, last(f"([{''.join(PRIORITY_SIGNS)}])")).alias("priority"), rule.alias("recurrence"), tags.alias("tags"))


#: What the value of a sign's field may be, and the sign that may follow a sign to ask for its picture.
VALUES = {"date": r"\d{4}-\d{2}-\d{2}", "recurrence": r"[a-zA-Z0-9, !]+", "on_completion": r"[a-zA-Z]+", "id": r"[a-zA-Z0-9_-]+", "depends_on": r"[a-zA-Z0-9_-]+( *, *[a-zA-Z0-9_-]+)*"}
OTHER_FIELDS, PICTURE = {"🏁": "on_completion", "🆔": "id", "⛔": "depends_on"}, "\ufe0f"


def _signs() -> dict[str, str]:
    dates = {sign: name for name, signs in DATE_SIGNS.items() for sign in signs}
    return dates | {sign: "priority" for sign in PRIORITY_SIGNS} | {REPEAT_SIGN: "recurrence"} | OTHER_FIELDS


_TRAILING_TAG = re.compile(r"""(?:^|\s)(#[^\s!@#$%^&*(),.?":{}|<>]+)$""")
_BLOCK = re.compile(r" \^([a-zA-Z0-9-]+)$")


def trailing(text: str) -> tuple[str, list[tuple[str, str, int, int]], list[str], str | None]:
    """(description, fields, tags, block) of a task's text, read from its end to the first word that is no field.

    A field is a sign, perhaps with PICTURE behind it, and a value that its family allows (a priority has none): (family, value, where the
    sign stands, where the value ends), in the order of the text. Tags between fields go with them. A block link is ` ^name` at the very
    end. What stands before is the description, whatever signs it has. Each sign is looked at once.
    """
    end, block, found, tags = len(text.rstrip()), None, [], []
    if m := _BLOCK.search(text[:end]):
        block, end = m[1], len(text[: m.start()].rstrip())
    kinds = _signs()
    places = [k for k, c in enumerate(text[:end]) if c in kinds]
    while end:
        while places and places[-1] >= end:
            places.pop()
        if places:
            at = places[-1]
            family = kinds[text[at]]
            value = text[at + 1 : end].removeprefix(PICTURE)
            if family == "priority":
                known = PRIORITY_SIGNS[text[at]] if not value else None
            else:
                bare = value.lstrip()
                allowed = VALUES.get(family, VALUES["date"])
                known = bare if re.fullmatch(allowed, bare) else None
            if known is not None:
                found.append((family, known, at, end))
                end = len(text[:at].rstrip())
                continue
        word = text.rfind("#", 0, end)
        if word < 0 or not (m := _TRAILING_TAG.match(text, max(word - 1, 0), end)):
            break
        tags.append(m[1])
        end = len(text[:word].rstrip())
    return text[:end], found[::-1], tags[::-1], block


def trailing_fields(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, description, fields, tags, block) of every task text by trailing(); a null text is empty."""
    kind = df.schema[id_col].dataType.simpleString()
    field = pa.struct([("family", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [trailing(x or "") for x in batch.column(1).to_pylist()]
            fields_ = pa.array([[dict(zip(("family", "value", "start", "end"), f, strict=True)) for f in r[1]] for r in rows], pa.list_(field))
            yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.string()), fields_, pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], ["id", "description", "fields", "tags", "block"])

    ship(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, description string, fields array<struct<family:string,value:string,start:int,end:int>>, tags array<string>, block string")
    return out.withColumnRenamed("id", id_col)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def recurrence(text: Column, strict: bool = True) -> Column:
    """A rule as struct(kind, n, days, month, when_done), null where it is none of: every [n] days, weeks, months or years, every weekday,
    every [week on] names of weekdays, every month on the nth or the last, every month's name on the nth; each may end in 'when done'.

    n is the number of units or the day; days count from 0 for Monday. Ordinals need their right suffix, weekdays may not repeat, and a
    day of a named month must be one that it has every year. n is 2 to 999; when not strict 1 to 9999, with or without an s at the unit.
    Words are looked up one by one: the second word tells what may follow, and numbers are read as values and checked as such.
    """
    clean = F.trim(text)
    low = F.lower(clean)
    known = (clean != "") & (F.translate(clean, RULE_LETTERS, "") == "")
    done = F.endswith(low, F.lit(WHEN_DONE)) & (F.length(low) > len(WHEN_DONE))
    body = F.trim(F.when(done, F.substring(low, F.lit(1), F.length(low) - len(WHEN_DONE))).otherwise(low))
    return once(F.when(known, F.struct(F.split(body, " +").alias("words"), done.alias("when_done"))), lambda x: _rule(x["words"], x["when_done"], strict))


def _looked_up(values: dict[str, int], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), word)


def _whole(digits: Column, low: int, high: int) -> Column:
    """A number written without a sign or leading zeros, null beyond its bounds."""
    n = digits.try_cast("int")
    return F.when((n.cast("string") == digits) & n.between(low, high), n)


def _nth(word: Column) -> Column:
    """The number of an ordinal such as 22nd, null where the suffix is another number's."""
    n = _whole(F.substring(word, F.lit(1), F.length(word) - 2), 1, 31)
    ending = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in (1, "st", 2, "nd", 3, "rd")]), F.when(n.between(11, 13), 0).otherwise(n % 10)), F.lit("th"))
    return F.when(F.right(word, F.lit(2)) == ending, n)


def _rule(words: Column, when_done: Column, strict: bool) -> Column:
    word, size = lambda k: F.get(words, k), F.size(words)
    none = F.lit(None).cast("int")
    rule = lambda kind, n=none, days=None, month=none: F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), n.cast("int").alias("n"), (F.array().cast("array<int>") if days is None else days).alias("days"), month.alias("month"), when_done.alias("when_done"))
    units = F.array(*[F.lit(u) for u in UNITS])
    named = lambda w, ending: F.try_element_at(units, F.nullif(F.array_position(F.transform(units, lambda u: F.concat(u, F.lit(ending))), w), F.lit(0)).cast("int"))
    any_form = lambda w: F.coalesce(named(w, ""), named(w, "s"))
    one, many = (named(word(1), ""), named(word(2), "s")) if strict else (any_form(word(1)), any_form(word(2)))
    n = _whole(word(1), *((2, 999) if strict else (1, 9999)))
    # a list of weekdays stands after 'every' or after 'every week on'
    on = (word(1) == "week") & (word(2) == "on") & (size > 3)
    names = F.split(F.array_join(F.slice(words, F.when(on, 4).otherwise(2), size), " "), ", ?")
    days = F.transform(names, lambda w: _looked_up({d: k for k, d in enumerate(WEEKDAYS)}, w))
    listed = ~F.exists(days, lambda d: d.isNull()) & (F.size(F.array_distinct(days)) == F.size(days))
    dated = (size == 5) & (word(2) == "on") & (word(3) == "the")
    nth, month = _nth(word(4)), _looked_up({m: k + 1 for k, m in enumerate(MONTHS)}, word(1))
    longest = _looked_up(dict(zip(MONTHS, MONTH_DAYS, strict=True)), word(1))
    return F.when(
        word(0) == "every",
        F.when((size == 2) & one.isNotNull(), rule(one, F.lit(1)))
        .when((size == 3) & many.isNotNull() & n.isNotNull(), rule(many, n))
        .when((size == 2) & (word(1) == "weekday"), rule("weekday", F.lit(1)))
        .when(dated & (word(1) == "month") & (word(4) == "last"), rule("month_last", F.lit(1)))
        .when(dated & (word(1) == "month") & nth.isNotNull(), rule("month_on", nth))
        .when(dated & (nth <= longest), rule("year_on", nth, None, month))
        .when((size > 1) & listed, rule("week_on", F.lit(1), days)),
    )


def next_by_rule(rule: Column, anchor: Column, strict: bool = True) -> Column:
    """The first date after an anchor by a rule of `recurrence`. Months clamp to their end; yearly from February 29 there is none, or when not strict the 28th."""
    return once(F.struct(rule.alias("rule"), anchor.alias("day")), lambda x: _next(x["rule"], x["day"], strict))


def _next(rule: Column, anchor: Column, strict: bool) -> Column:
    kind, n = rule["kind"], rule["n"]
    today = F.weekday(anchor)
    first = F.trunc(anchor, "month")
    ahead = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.add_months(first, i))
    holds = F.filter(F.transform(ahead, lambda m: F.when(F.day(F.last_day(m)) >= n, F.date_add(m, n - 1))), lambda d: d > anchor)
    own = F.add_months(F.trunc(anchor, "year"), rule["month"] - 1)
    named = F.date_add(own, n - 1)
    later = F.date_add(F.add_months(own, 12), n - 1)
    return (
        F.when(kind == "day", F.date_add(anchor, n)).when(kind == "week", F.date_add(anchor, n * 7)).when(kind == "month", F.add_months(anchor, n))
        .when((kind == "year") & (~((F.month(anchor) == 2) & (F.day(anchor) == 29)) | F.lit(not strict)), F.add_months(anchor, n * 12))
        .when(kind == "weekday", F.date_add(anchor, F.when(today == 4, 3).when(today == 5, 2).otherwise(1)))
        .when(kind == "week_on", F.date_add(anchor, F.array_min(F.transform(rule["days"], lambda d: F.pmod(d - today - 1, F.lit(7)) + 1))))
        .when(kind == "month_last", F.when(F.last_day(anchor) > anchor, F.last_day(anchor)).otherwise(F.last_day(F.add_months(first, 1))))
        .when(kind == "month_on", F.array_min(holds))
        .when(kind == "year_on", F.when(named > anchor, named).otherwise(later))
    )


def similarity_terms(text: Column, n: int = 8) -> Column:
    """The n longest different words of a text, in lower case; of equal length the alphabetically first."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    ordered = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["w"])
