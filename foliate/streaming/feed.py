"""The change feed as keyed state: appends of each scope are numbered without holes, however the log is cut into batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliate.session import ship

# the driver starts a Python process of its own for keyed state, which has no shipped package: what it needs travels with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Why a gap is there: events that could not be recorded, and events over the most of one append.
WRITE_FAILED, OVERFLOW = "write_failed", "pass_overflow"
GAP, RESET, MISS, MOVED, DELETED = "gap", "reset", "miss", "moved", "deleted"

#: A log row: item 1..items of append 1, 2, ... of a scope. A miss stands for `count` events that were lost before its append.
ITEM = T.StructType(
    [T.StructField("append", T.LongType()), T.StructField("item", T.LongType()), T.StructField("items", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("kind", "path", "from_path", "hash", "reason")), T.StructField("count", T.LongType()), T.StructField("quiet", T.BooleanType())]
)
_LINE = [("seq", "long"), ("append", "long"), ("kind", "string"), ("path", "string"), ("from_path", "string"), ("hash", "string"), ("reason", "string"), ("gap_reason", "string"), ("gap_count", "long")]


def _plain(value: object) -> object:
    """None for what pandas has instead of it."""
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


class Scope:
    """The feed of one scope: what has been recorded last, and how an append adds to it."""

    def __init__(self, at: int, seq: int, lost: int, last_kind: str | None, latest) -> None:
        self.at, self.seq, self.lost, self.last_kind, self.latest = at, seq, lost, last_kind, latest

    def says_the_same(self, e: dict) -> bool:
        """Whether the newest event at the path tells what e does; a move must be the newest at both its ends."""
        old = self.latest.get(e["path"])
        if old is None or old[1] != e["kind"]:
            return False
        if e["kind"] == DELETED:
            return old[4] == e["reason"]
        if e["kind"] == MOVED:
            source = self.latest.get(e["from_path"])
            return old[2] == e["from_path"] and source is not None and source[0] == old[0]
        return old[3] == e["hash"]

    def add(self, items: list[dict], most: int) -> Iterator[tuple]:
        """The lines of one append: a gap for what was lost before it, its events, a gap for those over `most` (0: no end)."""
        self.at = items[0]["append"]
        self.lost += sum(int(e["count"] or 1) for e in items if e["kind"] == MISS)
        events, kept = [e for e in items if e["kind"] != MISS], []
        if not events:
            return
        again = self.last_kind == RESET and not self.lost
        for e in events:
            if not (e["quiet"] and (again if e["kind"] == RESET else self.says_the_same(e))):
                kept.append(e)
        over = len(kept) - most if most else 0
        if self.lost:
            yield self.line(dict.fromkeys(("path", "from_path", "hash", "reason")) | {"kind": GAP}, WRITE_FAILED, self.lost)
            self.lost = 0
        for e in kept[:most] if over > 0 else kept:
            yield self.line(e, None, None)
        if over > 0:
            yield self.line(dict.fromkeys(("path", "from_path", "hash", "reason")) | {"kind": GAP}, OVERFLOW, over)

    def line(self, e: dict, gap_reason: str | None, gap_count: int | None) -> tuple:
        self.seq += 1
        self.last_kind = e["kind"]
        meta = e["kind"] in (GAP, RESET)
        source = e["from_path"] if e["kind"] == MOVED else None
        if not meta:
            for path in {e["path"], source} - {None}:
                self.latest[path] = (self.seq, e["kind"], source, e["hash"], e["reason"])
        return (self.seq, self.at, e["kind"], None if meta else e["path"], source, e["hash"], e["reason"], gap_reason, gap_count)


class _Latest(dict):
    """The newest event at each path: what is asked for comes from the state once, what changes goes back at the end."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.changed = state, set()

    def get(self, path, default=None):
        if path not in self:
            key = (path,)
            have = self.state.getValue(key) if path is not None and self.state.containsKey(key) else None
            super().__setitem__(path, None if have is None else tuple(_plain(x) for x in have))
        return self[path]

    def __setitem__(self, path, value) -> None:
        super().__setitem__(path, value)
        self.changed.add(path)

    def keep(self) -> None:
        for path in self.changed:
            self.state.updateValue((path,), self[path])


class FeedWriter(StatefulProcessor):
    """Takes log rows in any order and any batches; an append is recorded once it is whole and all before it are."""

    def __init__(self, scope: str, most: int) -> None:
        self.scope, self.most = scope, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "at long, seq long, lost long, last_kind string")
        self.waiting = handle.getListState("waiting", ITEM)
        self.latest = handle.getMapState("latest", "path string", "seq long, kind string, from_path string, hash string, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = tuple(_plain(x) for x in self.end.get()) if self.end.exists() else (0, 0, 0, None)
        latest = _Latest(self.latest)
        scope = Scope(*end, latest)
        appends: dict[int, dict[int, dict]] = {}
        names = ITEM.names
        for row in self.waiting.get() if self.waiting.exists() else ():
            e = dict(zip(names, map(_plain, row), strict=True))
            appends.setdefault(int(e["append"]), {})[int(e["item"])] = e
        for batch in rows:
            for row in batch[names].itertuples(index=False, name=None):
                e = dict(zip(names, map(_plain, row), strict=True))
                if e["append"] > scope.at:  # a row that comes twice, or after its append, adds nothing
                    appends.setdefault(int(e["append"]), {})[int(e["item"])] = e
        out = []
        while (ready := appends.get(scope.at + 1)) and len(ready) == next(iter(ready.values()))["items"]:
            del appends[scope.at + 1]
            out += scope.add([ready[k] for k in sorted(ready)], self.most)
        whole = lambda x: None if x is None else int(x)
        self.waiting.put([tuple(whole(e[n]) if n in ("append", "item", "items", "count") else e[n] for n in names) for a in appends.values() for e in a.values()]) if appends else self.waiting.clear()
        self.end.update((scope.at, scope.seq, scope.lost, scope.last_kind))
        latest.keep()
        frame = pd.DataFrame(out, columns=[n for n, _ in _LINE]).astype({"seq": "Int64", "append": "Int64", "gap_count": "Int64"})
        frame.insert(0, self.scope, key[0])
        yield frame

    def close(self) -> None:
        pass


def appended(stream: DataFrame, scope: str, most: int = 0) -> DataFrame:
    """(scope, seq, append, kind, path, from_path, hash, reason, gap_reason, gap_count) of a stream of ITEM rows with a scope.

    Each append adds lines with the numbers after the scope's last: a gap for events lost before it (misses, in however many rows), then its
    events, then a gap for those over `most`. A quiet row says nothing where the newest event at its path says the same already, nor a
    quiet reset right after a reset. Appends count from 1; one that isn't whole, or comes before an earlier one, waits. So any cut of a log
    into batches, and any stop in between, gives the same feed. State per scope: its end, rows that wait, and the newest event at each path.
    """
    ship(stream.sparkSession)
    kind = stream.schema[scope].dataType.simpleString()
    rows = stream.select(scope, *ITEM.names)
    return rows.groupBy(scope).transformWithStateInPandas(FeedWriter(scope, most), f"{scope} {kind}, " + ", ".join(f"{n} {t}" for n, t in _LINE), "Append", "None")


def record(stream: DataFrame, scope: str, folder: str, most: int = 0) -> DataFrame:
    """Adds all of a stream that is there to the feed in a shared folder and gives the whole feed; a later call goes on where this one ended."""
    spark = stream.sparkSession
    out = with_states(spark, lambda: appended(stream, scope, most).writeStream.format("parquet").option("path", f"{folder}/feed").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    out.awaitTermination()
    return spark.read.schema(out_schema(stream, scope)).parquet(f"{folder}/feed")


def out_schema(stream: DataFrame, scope: str) -> str:
    return f"{scope} {stream.schema[scope].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in _LINE)


def with_states(spark: SparkSession, start):
    """start() under the state store that keyed state needs; the session's own setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
