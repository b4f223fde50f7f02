"""Quotation linking: messages answer the messages whose passages they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import drop, met, text_of, written

_MARKS = r"^(?:[ \t]{0,3}>)+"
#: A line that announces a quotation, in four languages.
_SAID = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"

#: Letters and digits that a passage must have to be looked for in other conversations: "Thanks!" is anybody's.
TELLING = 20

#: Slots of hashes that every task gets: a bound of 16 MB however many quotations there are.
SLOTS = 1 << 20


def normal(text: Column) -> Column:
    """Lower case, white space single and trimmed: reflowed quotations stay equal."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns computed once for each row: Catalyst doesn't inline over a generator, as it would do into every step of a lambda."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _blocks(df: DataFrame) -> DataFrame:
    """df(text) with blocks, an array of (level, passage): runs of lines of one quote level without blank lines.

    The level of a line is its number of leading > marks; a line of any level that announces a quotation has level -1 if a
    line of a deeper level comes next. A blank line of any level ends a block and is in none. Work is linear in the lines.
    """
    df = _held(df, l=F.split("text", r"\r\n|\r|\n", -1))
    line = lambda x: F.regexp_replace(x, _MARKS + r"[ \t]?", "")
    parts = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("depth"), line(x).alias("line"))
    df = _held(df, p=F.transform("l", parts)).drop("l")
    n = F.size("p")
    deeper = lambda x, i: (i < n - 1) & (F.col("p")[F.least(i + 1, n - 1)]["depth"] > x["depth"])
    level = F.transform("p", lambda x, i: F.when(deeper(x, i) & x["line"].rlike(_SAID), -1).otherwise(x["depth"]))
    df = _held(df, level=level, blank=F.transform("p", lambda x: F.trim(x["line"]) == ""))
    # a block begins at a line that isn't blank after one that is, or of another level
    apart = lambda i, j: F.col("blank")[j] | (F.col("level")[i] != F.col("level")[j])
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: ~F.col("blank")[i] & ((i == 0) | apart(i, F.greatest(i - 1, F.lit(0)))))
    stops = F.filter(places, lambda i: ~F.col("blank")[i] & ((i == n - 1) | apart(i, F.least(i + 1, n - 1))))
    df = _held(df, starts=starts, stops=stops)
    inside = lambda s, k: F.transform(F.slice("p", s + 1, F.col("stops")[k] - s + 1), lambda x: x["line"])
    cut = lambda s, k: F.struct(F.col("level")[s].alias("level"), F.array_join(inside(s, k), "\n").alias("passage"))
    return _held(df, blocks=F.transform("starts", cut)).drop("p", "level", "blank", "starts", "stops")


def _runs(df: DataFrame) -> DataFrame:
    """df(blocks) with runs: neighbouring blocks of one level with their passages joined, as what is quoted over blank lines."""
    n = F.size("blocks")
    level = lambda i: F.col("blocks")[i]["level"]
    begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (level(i) != level(F.greatest(i - 1, F.lit(0))))))
    df = _held(df, begins=begins)
    df = _held(df, ends=F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(n)))
    inside = lambda s, k: F.transform(F.slice("blocks", s + 1, F.col("ends")[k] - s), lambda b: b["passage"])
    joined = lambda s, k: F.struct(level(s).alias("level"), F.array_join(inside(s, k), "\n").alias("passage"), inside(s, k).alias("blocks"))
    return _held(df, runs=F.transform("begins", joined)).drop("begins", "ends")


def _parts(passage: Column) -> Column:
    """The lines and the sentences of a passage that have a letter or a digit."""
    sentences = F.split(F.regexp_replace(passage, r"\s+", " "), r"(?<=[.!?…])\s+|(?<=[。！？])")
    return F.filter(F.array_distinct(F.concat(F.split(passage, "\n"), sentences)), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _hash(passage: Column) -> Column:
    return _digest(normal(passage))


def _telling(passage: Column) -> Column:
    return F.length(F.regexp_replace(passage, r"[^\p{L}\p{N}]", "")) >= TELLING


def _met(quotes: DataFrame, first: DataFrame, original: str, part: int) -> DataFrame:
    """quotes(conv, order, mid, level, unit, h, telling) that have an original, with its place: (mid, level, unit, part, scope, pconv, porder).

    What everybody quotes is a hot key of the search in other conversations: it goes by broadcast of its one row of originals.
    """
    first = first.where(F.col(original).isNotNull())
    here = first.select(F.col("h").alias("h1"), F.col("conv").alias("conv1"), F.col(original).alias("here"))
    near = quotes.join(here, F.expr("h = h1 AND conv <=> conv1"), "left").withColumn("here", F.expr("CASE WHEN here < `order` THEN here END"))
    near = written(near.select("conv", "mid", "level", "unit", "h", "telling", "here"), "near")
    # the two least conversations that have it: one of them isn't the quoting one
    place = F.struct(F.col("conv").isNull().alias("none"), "conv", F.col(original).alias("original"))
    asked = near.where("here IS NULL AND telling")
    times = asked.groupBy("h").agg(F.count("*").alias("n"))
    least = first.join(times, "h").select("h", "n", place.alias("place")).withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("place"))).where("rank <= 2")
    away = written(least.groupBy("h").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("place")).alias("places")), "away")
    far = met(asked, away, ["h"], "n", asked.count()).withColumn("away", F.get(F.filter("places", lambda x: ~x["conv"].eqNullSafe(F.col("conv"))), F.lit(0))).where("away IS NOT NULL")
    columns = ["mid", "level", "unit", F.lit(part).alias("part")]
    return near.where("here IS NOT NULL").select(*columns, F.lit(0).alias("scope"), F.col("conv").alias("pconv"), F.col("here").alias("porder")).union(
        far.select(*columns, F.lit(1), F.col("away.conv"), F.col("away.original"))
    )


def linked(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for every row of df: its text without quotations, what it answers, and its place in reply order.

    (conv, turn, role, reply_text, n_quoted, deepest, n_linked, link_scope, parent_conv, parent_turn, thread_turn, depth). Sorted
    by (conv, thread_turn, turn) every message comes after the one it answers and threads stay together.

    A passage is a block of lines of one quote level, or blocks joined over blank lines; it is compared by 128 bits of the SHA-256 of its
    normalised text with the unquoted passages, runs and whole unquoted texts of all messages. The original of a passage is the first message, by
    turn, of the same conversation that has it and comes before the quoting one; else, for a passage of TELLING letters and digits, the first
    message of all conversations that has it, in the order of conversations, another one than that of the quotation. A quoted block that
    is linked neither by itself nor as a part of a run is a trimmed one: its lines and sentences meet those of the unquoted blocks
    by the same rules, and the block counts as linked once. A message answers the original of its shallowest linked
    quotation, whole passages before lines and sentences, the latest if there are several; threads follow answers within a conversation.

    Originals are one row for each passage and conversation before they meet quotations, and a message's answers are one
    row before they meet messages, so a passage that a third of all rows quote or hold gives no product. Depth and
    thread come from pointer jumping over linked messages alone, in as many rounds as the logarithm of the deepest thread.

    Null text is empty: no passages, an empty reply. A null turn comes last in its conversation; rows with a null conversation
    are one conversation. Rows equal in all four columns are one message and give equal rows. Other columns are not read.
    """
    base = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("text"))
    base = base.withColumn("mid", _digest(F.to_json(F.struct("conv", "turn", "role", "text"))))
    cut = _runs(_blocks(base))
    own = F.filter("blocks", lambda b: b["level"] == 0)
    reply = F.trim(F.array_join(F.transform(own, lambda b: b["passage"]), "\n\n"))
    quoted = F.filter("blocks", lambda b: b["level"] > 0)
    messages = cut.select(
        "conv", "turn", "role", "mid",
        F.when(~F.col("text").rlike(r"(?m)^[ \t]{0,3}>"), F.trim("text")).otherwise(reply).alias("reply_text"),
        F.size(quoted).alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(quoted, lambda b: b["level"])), F.lit(0)).alias("deepest"),
        "runs",
    )
    messages = written(messages.withColumn("order", F.struct(F.col("turn").isNull().alias("none"), "turn", "mid")), "messages")

    quotes = messages.where("deepest > 0").select("conv", "order", "mid", F.inline(F.filter("runs", lambda r: r["level"] > 0)))
    quotes = quotes.select("conv", "order", "mid", "level", "passage", _hash(F.col("passage")).alias("run"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "blocks")).alias("block"))
    quotes = quotes.withColumn("h", F.when(F.col("block").isNull(), F.col("run")).otherwise(_hash(F.col("block"))))
    quotes = quotes.withColumn("telling", _telling(F.coalesce("block", "passage")))
    quotes = written(quotes.groupBy("conv", "order", "mid", "level", "run", "h").agg(F.min("block").alias("block"), F.max("telling").alias("telling")), "quotes")

    # originals that nobody quotes go before they are grouped: those whose hash is in no slot of a quoted one, of SLOTS at most
    slot = F.pmod(F.xxhash64("h"), F.lit(SLOTS)).cast("int").alias("slot")
    quoted = quotes.select("h").union(quotes.where("block IS NOT NULL").select(F.explode(_parts(F.col("block"))).alias("p")).select(_hash(F.col("p")).alias("h")))
    slots = F.broadcast(quoted.select(slot).distinct())
    runs = F.filter("runs", lambda r: r["level"] == 0)
    whole = F.concat(F.flatten(F.transform(runs, lambda r: F.concat(F.array(r["passage"]), r["blocks"]))), F.array("reply_text"))
    parts = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(r["blocks"], _parts))))
    mark = lambda x, is_whole: F.transform(F.array_distinct(x), lambda p: F.struct(p.alias("p"), F.lit(is_whole).alias("whole")))
    first = messages.select("conv", "order", F.inline(F.concat(mark(whole, True), mark(parts, False)))).where("trim(p) <> ''")
    first = first.select("conv", "order", "whole", _hash(F.col("p")).alias("h")).withColumn("slot", slot).join(slots, "slot", "left_semi")
    first = written(first.groupBy("h", "conv").agg(F.min(F.when(F.col("whole"), F.col("order"))).alias("as_whole"), F.min(F.when(~F.col("whole"), F.col("order"))).alias("as_part")), "first")

    found = written(_met(quotes.select("conv", "order", "mid", "level", "h", F.col("h").alias("unit"), "telling").distinct(), first, "as_whole", 0), "met")
    done = found.select(F.col("mid").alias("mid1"), F.col("unit").alias("unit1")).distinct()
    rest = quotes.where("block IS NOT NULL")
    for column in ("h", "run"):
        rest = rest.join(done, (F.col("mid") == F.col("mid1")) & (F.col(column) == F.col("unit1")), "left_anti")
    trimmed = rest.select("conv", "order", "mid", "level", F.col("h").alias("unit"), F.explode(_parts(F.col("block"))).alias("p")).select("conv", "order", "mid", "level", "unit", _hash(F.col("p")).alias("h"), _telling(F.col("p")).alias("telling")).distinct()
    found = found.union(_met(trimmed, first, "as_part", 1))
    rank = F.struct("scope", "level", "part", F.when(F.col("porder.none"), -9223372036854775808).otherwise(-F.col("porder.turn")).alias("late"), "porder", "pconv")
    answers = found.groupBy("mid").agg(F.count_distinct("unit").cast("int").alias("n_linked"), F.min(rank).alias("best"))
    answers = written(answers.select("mid", "n_linked", "best.scope", F.col("best.pconv").alias("parent_conv"), F.col("best.porder.turn").alias("parent_turn"), F.col("best.porder.mid").alias("parent")), "answers")
    for table in (quotes, first):
        drop(table)
    places = _threads(answers.where("scope = 0").select("mid", "parent", "parent_turn"))
    full = messages.drop("runs", "order").join(answers.drop("parent"), "mid", "left").join(places, "mid", "left")
    return full.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_text", "n_quoted", "deepest",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.when(F.col("scope") == 0, "conversation").when(F.col("scope") == 1, "corpus").alias("link_scope"),
        F.col("parent_conv"), "parent_turn",
        F.when(F.col("depth").isNotNull(), F.col("thread_turn")).otherwise(F.col("turn")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def _threads(answers: DataFrame) -> DataFrame:
    """(mid, thread_turn, depth) of messages that answer another, from (mid, parent, parent_turn): doubles the reach of pointers each round."""
    now = written(answers.select("mid", F.col("parent").alias("up"), F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("depth")), "threads")
    while now.join(now.select(F.col("mid").alias("up")), "up", "left_semi").limit(1).count():
        above = now.select(F.col("mid").alias("up"), F.col("up").alias("up2"), F.col("thread_turn").alias("turn2"), F.col("depth").alias("depth2"))
        after = now.join(above, "up", "left").select("mid", F.coalesce("up2", "up").alias("up"), F.when(F.col("up2").isNotNull(), F.col("turn2")).otherwise(F.col("thread_turn")).alias("thread_turn"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        after = written(after, "threads")
        drop(now)
        now = after
    return now.select("mid", "thread_turn", "depth")
