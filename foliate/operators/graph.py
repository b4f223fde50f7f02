"""The link graph: edges from pages, resolution, neighbourhoods, orphans and hubs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.storage import drop, written


def links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, position, target) for every link of a page, in document order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)
    return pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("position", "target"))


def resolved(edges: DataFrame, notes: DataFrame, id_col: str, path: str) -> DataFrame:
    """Edges (source, folder, target) with dst: the exact path, else the same folder, else a unique stem, else the closest stem, else null.

    Each rule is a join against a lookup of unique keys, in order of precedence. Of several stems: fewest segments, shortest path, alphabetical.
    """
    stem = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[a-z]+)?$", 1)
    base = notes.select(F.col(id_col).alias("nid"), F.col(path).alias("npath"), stem.alias("stem"))
    exact = base.groupBy("npath").agg(F.min("nid").alias("by_path"))
    w = Window.partitionBy("stem").orderBy(F.size(F.split("npath", "/")), F.length("npath"), "npath", "nid")
    closest = base.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("stem", F.col("nid").alias("by_stem"))
    e = edges.withColumns({"full": F.concat_ws("/", F.nullif("folder", F.lit("")), "target"), "stem": F.regexp_extract("target", r"([^/]+?)(?:\.[a-z]+)?$", 1)})
    e = e.join(exact.withColumnRenamed("npath", "target"), "target", "left")
    e = e.join(exact.select(F.col("npath").alias("full"), F.col("by_path").alias("by_folder")), "full", "left").join(closest, "stem", "left")
    return e.withColumn("dst", F.coalesce("by_path", "by_folder", "by_stem")).drop("full", "stem", "by_path", "by_folder", "by_stem")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, distance, via) within `depth` steps of start(node), edges(a, b) taken both ways; via is the least node on a shortest way.

    Every round joins the newest nodes alone, leaves out those met before and is written, so the work is linear in the depth: edges are
    read once a round. Rounds end early where nothing new is met. Edges with a null end lead nowhere.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    front = start.select("node", F.lit(0).alias("distance"), F.lit(None).cast(start.schema["node"].dataType).alias("via"))
    rounds = [written(front.distinct(), "round")]
    for step in range(1, depth + 1):
        met = rounds[-1].select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("via"))
        # a node next to the newest ones can only have been met in these or in the round before
        for known in rounds[-2:]:
            met = met.join(known, "node", "left_anti")
        rounds.append(written(met.select("node", F.lit(step).alias("distance"), "via"), "round"))
        if rounds[-1].isEmpty():
            break
    drop(both)
    return reduce(DataFrame.union, rounds)


def backlinks(edges: DataFrame) -> DataFrame:
    """(node, incoming): distinct resolved sources of each node."""
    return edges.where("dst IS NOT NULL").groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("incoming"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes(node) without a resolved link in or out."""
    ends = edges.where("dst IS NOT NULL").select(F.col("src").alias("node")).union(edges.where("dst IS NOT NULL").select("dst"))
    return nodes.join(ends, "node", "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(total, dangling, unlinked): edges, edges without a target, and nodes that no edge names, dangling ones included."""
    named = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    free = nodes.join(named.where("node IS NOT NULL"), "node", "left_anti").agg(F.count("*").alias("unlinked"))
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("dst").isNull()).alias("dangling")).crossJoin(free)


def hubs(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n nodes that most sources link to."""
    return backlinks(edges).orderBy(F.desc("incoming"), "node").limit(n)


def joined_path(base: Column, name: Column) -> Column:
    """base/name with . and .. worked out; what climbs above the root keeps its .. segments."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit("")), name), "/"), lambda s: (s != "") & (s != "."))

    def step(path: Column, s: Column) -> Column:
        up = (s == "..") & F.coalesce(F.try_element_at(path, F.lit(-1)) != "..", F.lit(False))
        return F.when(up, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\u0000", F.lit(kind), *parts)


def _named(notes: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(key, nid, rank) of everything that notes(id, path) can be called, ranked among those with one key; of equal paths the least id counts."""
    at = notes.where("path IS NOT NULL").groupBy("path").agg(F.min("id").alias("nid"))
    folder, stem = F.regexp_extract("path", r"^(.*)/", 1), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    at = at.withColumns({"folder": folder, "stem": stem})
    names = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("p", F.col("path")), ("s", F.col("stem")), ("P", F.lower("path")), ("S", F.lower("stem")))])
    keys = at.select("nid", "path", "folder", F.explode(names).alias("n")).select("nid", "path", "folder", F.col("n.k").alias("k"), F.col("n.v").alias("v"))
    if aliases is not None:
        called = aliases.where("alias IS NOT NULL").select(F.col("id").alias("nid"), F.lower(F.trim("alias")).alias("v"))
        keys = keys.unionByName(called.join(at, "nid").select("nid", "path", "folder", F.lit("a").alias("k"), "v"))
    rank = F.struct(F.size(F.split("path", "/")), F.length("path"), "path")
    return keys.select("nid", rank.alias("rank"), F.explode(F.array(F.concat_ws("\u0000", "k", "v"), F.concat_ws("\u0000", "k", "v", "folder"))).alias("key"))


def _asked(edges: DataFrame) -> DataFrame:
    """edges(source, target) with what decides their answer: the source's folder and the trimmed target."""
    return edges.withColumns({"_folder": F.regexp_extract(F.coalesce("source", F.lit("")), r"^(.*)/", 1), "_name": F.trim(F.coalesce("target", F.lit("")))})


def _attempts(asks: DataFrame) -> DataFrame:
    """(_folder, _name, turn, key): the keys that an ask is tried by, in order."""
    one = asks.select("_folder", "_name").where("_name <> ''").withColumn("bare", F.regexp_replace("_name", r"\.md$", ""))
    styled = F.col("bare").contains("/") | F.col("_name").endswith(".md")
    one = one.withColumn("full", F.when(styled & F.col("bare").rlike(r"^\.\.?/"), joined_path(F.col("_folder"), F.col("bare"))).otherwise(F.col("bare")))
    near = lambda kind, v: [_key(kind, v, F.col("_folder")), _key(kind, v)]
    local = F.concat(F.col("_folder"), F.lit("/"), F.col("bare"), F.lit(".md"))
    base = F.regexp_extract("bare", r"([^/]*)$", 1)
    inside = F.col("_folder") != ""
    file = F.concat(F.col("full"), F.lit(".md"))
    tries = [F.when(styled, _key("p", file)), F.when(styled, _key("p", F.col("full"))), F.when(inside, _key("p", local)), *near("s", base)]
    tries += [F.when(styled, k) for v in (file, F.col("full")) for k in near("P", F.lower(v))] + [F.when(inside, k) for k in near("P", F.lower(local))]
    tries += near("S", F.lower(base)) + near("a", F.lower("bare")) + near("a", F.lower("_name"))
    return one.select("_folder", "_name", F.posexplode(F.array(*tries)).alias("turn", "key")).where("key IS NOT NULL")


def _answers(attempts: DataFrame, named: DataFrame) -> DataFrame:
    """(_folder, _name, dst): the best note of the first key that any note has, for asks that have one."""
    lookup = named.groupBy("key").agg(F.min_by("nid", "rank").alias("nid"))
    return attempts.join(lookup, "key").groupBy("_folder", "_name").agg(F.min_by("nid", "turn").alias("dst"))


def resolved_by_all_rules(edges: DataFrame, notes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """edges(source, target, ...) of paths and raw targets with dst, the id of the note meant in notes(id, path), or null.

    In order: the path (targets with a slash or .md; ./ and ../ begin at the source's folder), the source's folder, the stem, the same
    three in any case, an alias of aliases(id, alias) in any case. Of several notes: the one in the source's folder, fewest segments,
    shortest path, alphabetical. Case is folded by lower(). Null and empty targets have null; of equal paths the least id counts.

    Every note gives a few keys, every different (folder, target) its attempts in order: one join of keys and one grouping, however
    many rules there are, and links that repeat are resolved once.
    """
    asked = _asked(edges)
    meant = _answers(_attempts(asked.select("_folder", "_name").distinct()), _named(notes, aliases))
    return asked.join(meant, ["_folder", "_name"], "left").drop("_folder", "_name")


@dataclass
class Links:
    """Resolved links that can be kept up to date: the notes they were resolved against, the attempts of every ask, and the answers.

    recomputed: asks that the last change had resolved again; asks: how many there are.
    """

    notes: DataFrame
    aliases: DataFrame
    attempts: DataFrame
    answers: DataFrame
    recomputed: int
    asks: int

    def edges(self, edges: DataFrame) -> DataFrame:
        """edges(source, target, ...) with dst, which must be among those that link() or relinked() has seen."""
        return _asked(edges).join(self.answers, ["_folder", "_name"], "left").drop("_folder", "_name")


def linked(edges: DataFrame, notes: DataFrame, aliases: DataFrame) -> Links:
    """resolved_by_all_rules() as tables to go on from."""
    notes, aliases = written(notes.select("id", "path"), "notes"), written(aliases.select("id", "alias"), "aliases")
    asks = _asked(edges).select("_folder", "_name").where("_name <> ''").distinct()
    attempts = written(_attempts(asks), "attempts")
    n = attempts.select("_folder", "_name").distinct().count()
    return Links(notes, aliases, attempts, written(_answers(attempts, _named(notes, aliases)), "answers"), n, n)


def relinked(links: Links, edges: DataFrame, notes: DataFrame, aliases: DataFrame) -> Links:
    """The links after notes, aliases or edges changed; gives what linked() gives anew for the edges there are.

    An answer can only change if a note with one of the ask's keys was added, moved, deleted or called otherwise. So the keys of all notes
    at paths that changed, before and after, are met with the attempts, and only asks with such a key are resolved again, against the names
    that they try; asks of new edges come to them. Other answers stay as they are. Notes are compared once; no edge is resolved for it.
    """
    notes, aliases = written(notes.select("id", "path"), "notes"), written(aliases.select("id", "alias"), "aliases")
    other = lambda a, b: a.exceptAll(b).union(b.exceptAll(a))
    called = other(links.aliases, aliases).select("id").distinct()
    both = links.notes.union(notes)
    paths = written(other(links.notes, notes).select("path").union(both.join(called, "id", "left_semi").select("path")).where("path IS NOT NULL").distinct(), "paths")
    touched = [_named(n.join(paths, "path", "left_semi"), a).select("key") for n, a in ((links.notes, links.aliases), (notes, aliases))]
    stale = links.attempts.join(touched[0].union(touched[1]).distinct(), "key", "left_semi").select("_folder", "_name")
    asks = _asked(edges).select("_folder", "_name").where("_name <> ''").distinct()
    fresh = asks.join(links.attempts.select("_folder", "_name").distinct(), ["_folder", "_name"], "left_anti")
    again = written(stale.union(fresh).distinct(), "asks")
    tried = written(_attempts(again), "attempts")
    named = _named(notes, aliases).join(tried.select("key").distinct(), "key", "left_semi")
    answers = links.answers.join(again, ["_folder", "_name"], "left_anti").union(_answers(tried, named))
    attempts = links.attempts.join(again, ["_folder", "_name"], "left_anti").unionByName(tried)
    kept = written(attempts, "attempts")
    return Links(notes, aliases, kept, written(answers, "answers"), again.count(), kept.select("_folder", "_name").distinct().count())
