"""Blame: neighbouring versions aligned line by line, the matches followed back to the version that a line dates from; exported records read."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.session import ship
from foliate.storage import drop, written

#: Letters and digits that a moved line must have to be followed; cells of the table that aligns what unique lines leave open.
MOVED, CELLS = 20, 4_000_000


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest rising run of different numbers."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = [-1] * len(places)
    for k, p in enumerate(places):
        n = bisect_left(ends, p)
        before[k] = at[n - 1] if n else -1
        ends[n:] = [p, *ends[n + 1 :]] if n < len(ends) else [p]
        at[n:] = [k, *at[n + 1 :]] if n < len(at) else [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence by the usual table; nothing where the table would be too large."""
    if not a or not b or len(a) * len(b) > CELLS:
        return []
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        last, row = rows[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = last[j + 1] + 1 if x == b[j] else max(last[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and rows[i][j] == rows[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines (in old, in new), rising in both: equal ends first, then lines that are unique in both, then what lies between
    those in the same way, and a longest common subsequence where nothing is unique."""
    out, open_ = [], [(0, len(old), 0, len(new))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(old[a:b]), Counter(new[c:d])
        place = {x: k for k, x in enumerate(new[c:d], c) if there[x] == 1}
        both = [(k, place[x]) for k, x in enumerate(old[a:b], a) if here[x] == 1 and x in place]
        anchors = [both[k] for k in _rising([j for _, j in both])]
        if anchors:
            for (i, j), (x, y) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                open_.append((i + 1, x, j + 1, y))
            out += anchors
        else:
            out += [(a + i, c + j) for i, j in _common(old[a:b], new[c:d])]
    return sorted(out)


def followed(old: str, new: str) -> list[int]:
    """For each line of new the line of old that it comes from, or -1. White space in lines doesn't count.

    Lines that no alignment meets come from a line of old that has moved: one that is left over in both, has MOVED letters or digits, and is
    unique among these; then also equal neighbours of moved lines.
    """
    a, b = (["".join(x.split()) for x in text.split("\n")] for text in (old, new))
    found = [-1] * len(b)
    for i, j in aligned(a, b):
        found[j] = i
    used = {i for i in found if i >= 0}
    left, right = [i for i in range(len(a)) if i not in used], [j for j in range(len(b)) if found[j] < 0]
    here, there = Counter(a[i] for i in left), Counter(b[j] for j in right)
    at = {a[i]: i for i in left}
    for j in right:
        if here[b[j]] == 1 == there[b[j]] and len(re.findall(r"[^\W_]", b[j])) >= MOVED:
            found[j] = at[b[j]]
            used.add(at[b[j]])
    for step, order in ((1, right), (-1, right[::-1])):  # a moved block brings its short lines along
        for j in order:
            i = found[j - step] + step if 0 <= j - step < len(b) and found[j - step] >= 0 else -1
            if found[j] < 0 and 0 <= i < len(a) and i not in used and a[i] == b[j]:
                found[j] = i
                used.add(i)
    return found


def origins(versions: DataFrame, path: str, at: str, body: str) -> DataFrame:
    """(path, line, text, since) of each line of the last version of a path: the time of the version that the line, moved or re-indented
    though it may be, was first in. Lines count from 0; a null body is one empty line. Versions of a path have different times; null paths
    are a path of their own.

    Every pair of neighbouring versions is aligned on its own, wherever it is; the matches are chains, of which each round follows twice as
    much, so a path of n versions takes log2 n rounds. Rounds are written to the shared folder.
    """
    ship(versions.sparkSession)
    own = Window.partitionBy(path).orderBy(at)
    text = F.coalesce(F.col(body), F.lit(""))
    rows = versions.select(F.col(path).alias("path"), F.col(at).alias("at"), F.row_number().over(own).alias("v"), text.alias("new"), F.lag(text).over(own).alias("old"), F.lead(F.lit(1)).over(own).isNull().alias("last"))
    rows = written(rows, "pairs")
    kind = versions.schema[path].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[-1] * (new.count("\n") + 1) if old is None else followed(old, new) for old, new in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("path"), batch.column("v"), pa.array(found, pa.list_(pa.int32()))], ["path", "v", "found"])

    steps = rows.select("path", "v", "old", "new").mapInArrow(align, f"path {kind}, v int, found array<int>").select("path", "v", F.posexplode("found").alias("line", "from"))
    # of each line the version and line that it is known to come from, itself to begin with
    up = F.col("from") >= 0
    nodes = written(steps.select("path", "v", "line", F.when(up, F.col("v") - 1).otherwise(F.col("v")).alias("v0"), F.when(up, F.col("from")).otherwise(F.col("line")).alias("line0")), "lines")
    while True:
        above = nodes.select(F.col("path").alias("_path"), F.col("v").alias("v0"), F.col("line").alias("line0"), F.col("v0").alias("_v"), F.col("line0").alias("_line"))
        met = nodes.join(above, nodes["path"].eqNullSafe(above["_path"]) & (nodes["v0"] == above["v0"]) & (nodes["line0"] == above["line0"]))
        higher = written(met.select(nodes["path"], nodes["v"], nodes["line"], F.col("_v").alias("v0"), F.col("_line").alias("line0"), (F.col("_v") != nodes["v0"]).alias("moved")), "lines")
        drop(nodes)
        nodes = higher
        if nodes.where("moved").isEmpty():
            break
    ends = rows.where("last").select("path", "v", F.posexplode(F.split("new", "\n")).alias("line", "text"))
    born = rows.select(F.col("path").alias("_path"), F.col("v").alias("v0"), F.col("at").alias("since"))
    end = ends.join(nodes.withColumnRenamed("path", "_p"), F.col("path").eqNullSafe(F.col("_p")) & (ends["v"] == nodes["v"]) & (ends["line"] == nodes["line"])).select("path", ends["line"], "text", "v0")
    return end.join(born, F.col("path").eqNullSafe(F.col("_path")) & (end["v0"] == born["v0"])).select("path", "line", "text", "since")


_RECORD = r"(?m)^[0-9a-f]{40} \d+ \d+.*\n(?:[^\t\n].*\n)*\t.*$"


def porcelain(records: DataFrame, record: str) -> DataFrame:
    """(commit, line, text, author, mail, at, origin) of blame records with a full header for every line, plus the columns of records.

    A header is a 40-digit id, the old and the new number of the line, and further lines of a name and a value; the text follows a tab.
    What has another form gives no rows; names that are missing give null.
    """
    one = records.select("*", F.explode(F.regexp_extract_all(F.coalesce(record, F.lit("")), F.lit(_RECORD), 0)).alias("_one"))
    value = lambda name: F.nullif(F.regexp_extract("_one", rf"(?m)^{name} (.*)$", 1), F.lit(""))
    head = lambda k: F.regexp_extract("_one", r"^([0-9a-f]{40}) (\d+) (\d+)", k)
    mail = F.regexp_replace(value("author-mail"), "^<|>$", "")
    return one.select(
        *[c for c in records.columns if c != record], head(1).alias("commit"), head(3).cast("int").alias("line"), F.regexp_extract("_one", r"\n\t(.*)$", 1).alias("text"),
        value("author").alias("author"), mail.alias("mail"), F.timestamp_seconds(value("author-time").try_cast("bigint")).alias("at"), value("filename").alias("origin"),
    )
