"""Prefix trie of conversations: a skeleton of range-partition splitter paths, sorted shards for all other nodes."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import drop, in_arrow, text_of, written

#: Bytes that stand for a turn in a path; rows of the sample for each shard; turns that a shard should have; most shards.
STEP, SAMPLE, SHARD, MOST = 16, 32, 1 << 19, 8192
#: Bytes of conversation ids that go on as one row.
PIECE = 1 << 20
_EMPTY = hashlib.sha256().hexdigest()
_FOUND = pa.schema(
    [("kind", pa.int32()), ("spot", pa.int32()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")), ("ends", pa.string()), ("turn", pa.binary())]
)
_FOUND_DDL = "kind int, spot int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string, turn binary"
_NODE, _PART, _ENDS = 0, 1, 2


def paths(turns: DataFrame, shared: int = 6, family: int = 100) -> DataFrame:
    """(conv_id, path, sizes): every conversation with its opening turns taken from the first of its family.

    Turns go by turn, null first, equal ones by the digest of role and text; null role or text is empty; rows without conv_id belong to
    no conversation. Conversation c takes the first crc32(c) % `shared` turns of c - c % `family` (all if it has fewer, none if it isn't
    there) and then its own turns after as many. path has 16 bytes of SHA-256 of (role, text) a turn, sizes the code points of the text.
    Texts aren't shuffled; one conversation is one row of 20 bytes a turn, a family at most 2 * `family` such rows.
    """
    conv, role, text = F.col("conv_id").cast("long"), text_of("role"), text_of("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("d"), F.length(text).alias("n"))
    rows = turns.select((conv - conv % family).alias("base"), conv.alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL").repartition("base")
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, max(1, shared - 1)))).over(Window.partitionBy("base"))
    n = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    none = F.slice("own", 1, 0)
    whole = own.withColumn("first", first).select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), n), F.slice("own", n + 1, F.size("own"))).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("path"), F.transform("t", lambda x: x["n"]).alias("sizes"))


def common_steps(a: bytes, b: bytes) -> int:
    """How many whole turns the paths a and b have in common at their start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def splitters(sample: list[tuple[bytes, int, int]], shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 splitters of (path, conv_id, turns) rows, so that shards have about as many turns.

    A splitter is the shortest start of its path that sorts after the row before it, and has a conv_id only between equal paths.
    """
    rows = sorted(sample)
    ends = np.cumsum([n + 1 for _, _, n in rows])
    out: list[tuple[bytes, int]] = []
    for k in range(1, shards):
        at = int(np.searchsorted(ends, ends[-1] * k / shards, "right")) if rows else 0
        if 0 < at < len(rows):
            (before, _, _), (path, conv, _) = rows[at - 1], rows[at]
            cut = (path, conv) if before == path else (path[: STEP * (common_steps(before, path) + 1)], -(1 << 63))
            if not out or out[-1] < cut:
                out.append(cut)
    return out


def skeleton(cuts: list[tuple[bytes, int]]) -> tuple[dict[tuple[int, bytes], int], list[int]]:
    """Every start of every splitter path as a trie: {(number of the parent, turn): number} and each node's parent; parents come first, the root is 0."""
    spots, parents = {}, [-1]
    for path, _ in cuts:
        at = 0
        for k in range(0, len(path), STEP):
            step = (at, path[k : k + STEP])
            if step not in spots:
                spots[step] = len(parents)
                parents.append(at)
            at = spots[step]
    return spots, parents


class _Open:
    """A node whose members aren't all read yet."""

    __slots__ = ("spot", "size", "convs", "least", "children", "leaves", "saved", "ends", "held", "waiting")

    def __init__(self, spot: int, size: int) -> None:
        self.spot, self.size, self.convs, self.least = spot, size, 0, 1 << 63
        self.children = self.leaves = self.saved = 0
        self.ends, self.held, self.waiting = None, None, None


class _Shards:
    """Reads sorted (shard, path, sizes, conv_id) rows and gives the rows of _FOUND; holds the open nodes and their finished children."""

    def __init__(self, spots: dict[tuple[int, bytes], int]) -> None:
        self.spots, self.stack, self.path, self.shard, self.out = spots, [], b"", None, []

    def add(self, shard: int, path: bytes, sizes: np.ndarray, conv: int) -> None:
        if shard != self.shard:
            self.close(0)
            self.shard, self.path, self.stack = shard, b"", [_Open(0, 0)]
        shared, stack = common_steps(self.path, path), self.stack
        self.close(shared + 1)
        for d in range(shared, len(path) // STEP):
            spot = stack[-1].spot
            stack.append(_Open(self.spots.get((spot, path[d * STEP : (d + 1) * STEP]), -1) if spot >= 0 else -1, int(sizes[d])))
        self.path, top = path, stack[-1]
        top.convs, top.least = top.convs + 1, min(top.least, conv)
        if top.spot < 0:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(b",%d" % conv)
        else:
            top.held = top.held or [conv, [], 0]
            top.held[1].append(str(conv))
            top.held[2] += len(top.held[1][-1]) + 1
            if top.held[2] >= PIECE:
                self.piece(top)

    def piece(self, node: _Open) -> None:
        first, ids, _ = node.held
        self.out.append((_ENDS, node.spot, first, None, None, None, None, None, None, None, ",".join(ids), None))
        node.held = None

    def close(self, depth: int) -> None:
        """Finishes all open nodes of that depth or deeper."""
        stack = self.stack
        while len(stack) > depth:
            node = stack.pop()
            d, over = len(stack), stack[-1] if stack else None
            if over:
                over.convs, over.least = over.convs + node.convs, min(over.least, node.least)
            if node.spot >= 0:
                if node.held:
                    self.piece(node)
                self.out.append((_PART, node.spot, node.least, d, None, node.convs, node.children, node.leaves, node.saved, node.size, None, self.path[max(d - 1, 0) * STEP : d * STEP]))
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.size
            row = (node.convs, node.children, leaves, saved, node.size, node.ends.hexdigest() if node.ends else _EMPTY, self.path[(d - 1) * STEP : d * STEP])
            over.children, over.leaves, over.saved = over.children + 1, over.leaves + leaves, over.saved + saved
            if over.spot >= 0:
                self.out.append((_NODE, over.spot, node.least, d, None, *row))
            else:
                over.waiting = over.waiting or []
                over.waiting.append((node.least, row))
            for least, below in node.waiting or ():
                self.out.append((_NODE, -1, least, d + 1, node.least, *below))


def _dealt(cuts):
    """Adds to every conversation the number of its shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(cuts.value[0], k) for k in keys], pa.int32())
            yield pa.record_batch([shard, batch.column("conv_id"), batch.column("path"), batch.column("sizes")], ["shard", "conv_id", "path", "sizes"])

    return deal


def _scanned(cuts):
    """Sorted shards to nodes, partial skeleton nodes and pieces of the ids that end at skeleton nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Shards(cuts.value[1])

        def given(least: int) -> Iterator[pa.RecordBatch]:
            while len(found.out) > least:
                rows, found.out = found.out[:50_000], found.out[50_000:]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            sizes = batch.column("sizes")
            at, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy(zero_copy_only=False)
            for k, (shard, conv, path) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                found.add(shard, path, flat[at[k] : at[k + 1]], conv)
                if len(found.out) > 50_000:
                    yield from given(50_000)
        found.close(0)
        yield from given(0)

    return scan


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order of their ids."""
    spot, sha, done = None, None, []
    for batch in batches:
        for s, ids in zip(batch.column("spot").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if s != spot:
                if sha:
                    done.append((spot, sha.hexdigest()))
                spot, sha = s, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        done.append((spot, sha.hexdigest()))
    if done:
        yield pa.record_batch([pa.array([s for s, _ in done], pa.int32()), pa.array([h for _, h in done])], ["spot", "ends"])


def _rolled(parts: pa.Table, parents: list[int]) -> list[tuple]:
    """Partial skeleton nodes summed up from their children: (spot, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)."""
    have = {r["spot"]: r for r in parts.to_pylist()}
    for spot in sorted(have, reverse=True):  # children have larger numbers than their parents
        node = have[spot]
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        if spot:
            over = have[parents[spot]]
            over["n_children"] += 1
            over["n_leaves"] += node["n_leaves"]
            over["saved_tokens"] += node["saved_tokens"]
    return [(s, n["conv_id"], n["depth"], have[parents[s]]["conv_id"] if s else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["turn"]) for s, n in have.items()]


def trie(whole: DataFrame) -> DataFrame:
    """One row per node of the trie of paths(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn.

    A node is a distinct start of paths, the root the empty one. turn holds the bytes of its last turn in the paths (empty at the root),
    which lead to role and text. No conversations: no rows, not even a root. Equal paths are one node, whichever shards they are in.
    The driver holds splitters and the skeleton they make: at most MOST short starts of paths. Each shard gives sums for the skeleton nodes
    it meets, which are starts of its two splitters. The hash of the ids that end at one node is a chain, so one task reads these ids, in
    order and piece by piece.
    """
    spark = whole.sparkSession
    whole = written(whole, "paths")
    steps = F.floor(F.length("path") / STEP)
    n, turns = whole.agg(F.count("*"), F.sum(steps)).first()
    shards = min(MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns or 0) // SHARD)))
    wanted = min(1.0, SAMPLE * shards / max(n, 1))
    sample = whole.sample(wanted, seed=11) if wanted < 1 else whole
    cuts = splitters([(bytes(r[0]), r[1], r[2]) for r in sample.select("path", "conv_id", steps).toLocalIterator()], shards)
    spots, parents = skeleton(cuts)
    shared = spark.sparkContext.broadcast((cuts, spots))
    dealt = in_arrow(whole, _dealt(shared), "shard int, conv_id long, path binary, sizes array<int>")
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = written(in_arrow(ordered, _scanned(shared), _FOUND_DDL), "trie")
    drop(whole)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where(F.col("kind") == _PART).groupBy("spot").agg(F.min("conv_id").alias("conv_id"), *sums, *(F.max(c).alias(c) for c in ("depth", "size", "turn")))
    top = _rolled(parts.toArrow(), parents)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    bones = spark.createDataFrame(top, "spot int, " + ", ".join(f"{c} long" for c in columns) + ", turn binary")
    pieces = found.where(F.col("kind") == _ENDS).select("spot", "conv_id", "ends").repartition("spot").sortWithinPartitions("spot", "conv_id").select("spot", "ends")
    ends = in_arrow(pieces, _chained, "spot int, ends string")
    upper = bones.join(ends, "spot", "left").select(*columns, F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"), "turn")
    over = F.broadcast(bones.select("spot", F.col("conv_id").alias("over")))
    lower = found.where(F.col("kind") == _NODE).join(over, "spot", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    return upper.unionByName(lower.select(*columns, F.col("ends").alias("ends_sha256"), "turn"))


def nodes(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text) rows, whatever other columns there are."""
    return trie(paths(turns)).drop("turn")
