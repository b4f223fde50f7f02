"""Version history: exported commit records, lines of descent through renames, and the version that each line dates from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.storage import drop, written


def commits(records: DataFrame, record: str) -> DataFrame:
    """(commit, at, author, subject, status, path, from_path) of exported records, one row for each path that a commit changed.

    A record begins with a line of id, ISO time, author and subject, parted by U+001F. Each further line is a letter (A, M, D, T), a tab and
    a path; or R or C with a score, the old path and the new one. Records with another first line and lines of another form give no rows.
    """
    lines = F.split(F.col(record), "\n")
    rows = records.select(F.split(F.get(lines, 0), "\u001f").alias("h"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line")).where(F.size("h") == 4)
    part = F.split(F.col("line"), "\t")
    one = F.get(part, 0).rlike("^[AMDT]$") & (F.size(part) == 2)
    two = F.get(part, 0).rlike("^[RC][0-9]*$") & (F.size(part) == 3)
    return rows.where(one | two).select(
        F.get("h", 0).alias("commit"),
        F.get("h", 1).try_cast("timestamp").alias("at"),
        F.get("h", 2).alias("author"),
        F.get("h", 3).alias("subject"),
        F.substring(F.get(part, 0), 1, 1).alias("status"),
        F.when(two, F.get(part, 2)).otherwise(F.get(part, 1)).alias("path"),
        F.when(two, F.get(part, 1)).alias("from_path"),
    )


def _alive(rows: DataFrame, births: DataFrame, path: str, before: bool) -> DataFrame:
    """rows(at, path) with alive_from: the time of the last of births(path, at) at that path, up to the row's own time or strictly before it."""
    born = births.select(F.col("path").alias("_path"), F.col("at").alias("_at"), F.lit(1 if before else 0).alias("_order"), F.col("at").alias("_born"), F.lit(None).alias("_row"))
    asks = rows.select(F.col(path).alias("_path"), F.col("at").alias("_at"), F.lit(0 if before else 1).alias("_order"), F.lit(None).alias("_born"), F.struct(*rows.columns).alias("_row"))
    so_far = Window.partitionBy("_path").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    both = born.unionByName(asks).withColumn("_born", F.last("_born", ignorenulls=True).over(so_far))
    return both.where("_row IS NOT NULL").select("_row.*", F.col("_born").alias("alive_from"))


def lineages(changes: DataFrame) -> DataFrame:
    """changes(path, from_path, at, status) with root_path and root_at: the birth that a change descends from through renames.

    A path is born by A, C or R; a birth by R descends from the birth that was last at its old path before. A rename of a path without one is a
    root, and so is a change of a path without one: its root_at is null. A path has at most one change at a time; null paths are left out.
    Descent is halved in every round (a chain of n renames takes log2 n), and rounds are written to the shared folder, so none is computed again.
    """
    rows = changes.where("path IS NOT NULL")
    births = rows.where(F.col("status").isin("A", "C", "R")).select("path", "at", F.when(F.col("status") == "R", F.col("from_path")).alias("src"))
    moved = _alive(births.where("src IS NOT NULL"), births, "src", True)
    first = births.where("src IS NULL").withColumn("alive_from", F.lit(None).cast(births.schema["at"].dataType)).unionByName(moved)
    up = F.col("alive_from").isNotNull()
    first = first.select("path", "at", F.when(up, F.col("src")).otherwise(F.col("path")).alias("root_path"), F.coalesce("alive_from", "at").alias("root_at"))

    nodes = written(first, "lineages")
    while True:
        above = nodes.select(F.col("path").alias("root_path"), F.col("at").alias("root_at"), F.col("root_path").alias("_path"), F.col("root_at").alias("_at"))
        moved_on = ((F.col("_path") != F.col("root_path")) | (F.col("_at") != F.col("root_at"))).alias("_moved")
        higher = written(nodes.join(above, ["root_path", "root_at"]).select("path", "at", F.col("_path").alias("root_path"), F.col("_at").alias("root_at"), moved_on), "lineages")
        drop(nodes)
        nodes = higher
        if nodes.where("_moved").isEmpty():
            break
    known = nodes.select(F.col("path").alias("_path"), F.col("at").alias("_at"), "root_path", "root_at")
    out = _alive(rows, births, "path", False).join(known, (F.col("path") == F.col("_path")) & (F.col("alive_from") == F.col("_at")), "left")
    return out.select(*changes.columns, F.coalesce("root_path", "path").alias("root_path"), "root_at")


def line_origins(versions: DataFrame, path: str, at: str, body: str) -> DataFrame:
    """(path, line, text, since) of each line of the last version of a path: the time of the version since which every one has it.

    Equal lines of a version are told apart by their number among themselves. Lines count from 0; a null body is one empty line. Versions
    of a path have different times.
    """
    number = F.row_number().over(Window.partitionBy(path).orderBy(at))
    last = F.count("*").over(Window.partitionBy(path))
    rows = versions.select(F.col(path).alias("path"), F.col(at).alias("at"), number.alias("v"), last.alias("last"), F.split(F.coalesce(body, F.lit("")), "\n").alias("lines"))
    lines = rows.select("path", "at", "v", "last", F.posexplode("lines").alias("line", "text"))
    same = lines.withColumn("nth", F.row_number().over(Window.partitionBy("path", "text", "v").orderBy("line")))
    run = same.withColumn("run", F.col("v") - F.row_number().over(Window.partitionBy("path", "text", "nth").orderBy("v")))
    found = run.groupBy("path", "text", "nth", "run").agg(F.min("at").alias("since"), F.max("v").alias("end"), F.max_by("line", "v").alias("line"), F.max("last").alias("last"))
    return found.where("end = last").select("path", "line", "text", "since")


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression of whole names: `*`, `?`, `[abc]` and `[!abc]`."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
            k = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c.isascii() else c
        k += 1
    return f"(?s)^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the shell patterns; `*` takes slashes too. No patterns match nothing, nor does a null path."""
    out = F.lit(False)
    for glob in globs:
        out = out | F.coalesce(path.rlike(glob_pattern(glob)), F.lit(False))
    return out


def listed(files: DataFrame, path: str, folder: str, glob: str, recursive: bool, n: int) -> DataFrame:
    """(path, truncated): the first n paths below a folder, by path, whose last part matches a shell pattern; truncated: there are more."""
    rest = F.expr(f"substr({path}, {len(folder) + 1})")
    below = files.where(F.col(path).startswith(folder)).select(F.col(path).alias("path"), rest.alias("rest"))
    below = below if recursive else below.where(~F.contains("rest", F.lit("/")))
    top = below.where(F.element_at(F.split("rest", "/"), -1).rlike(glob_pattern(glob))).select("path").orderBy("path").limit(n + 1)
    whole = Window.partitionBy(F.lit(1))  # n + 1 rows at most
    rank = F.row_number().over(whole.orderBy("path"))
    return top.select("path", (F.count("*").over(whole) > n).alias("truncated"), rank.alias("rank")).where(F.col("rank") <= n).drop("rank")
