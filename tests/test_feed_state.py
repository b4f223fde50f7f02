"""The feed as keyed state against a plain reading of the log: any cut into batches, rows out of order, restarts."""

import random

import pytest

from foliate.storage import scratch
from foliate.streaming import feed


def log(draw, scopes=4):
    rows = []
    for scope in [*range(scopes - 1), None]:
        for append in range(1, draw.randrange(2, 9)):
            n = draw.randrange(1, 7)
            quiet = draw.random() < 0.6
            for item in range(1, n + 1):
                kind = draw.choice(["created", "modified", "deleted", "moved", "miss", "reset"])
                rows.append((scope, append, item, n, kind, draw.choice("ab"), draw.choice("abc") if kind == "moved" else None, draw.choice("hk") if kind in ("created", "modified") else None, draw.choice(["x", None]) if kind == "deleted" else None, draw.choice([1, 3]) if kind == "miss" else None, quiet))
    return rows


def plain(rows, most):
    out = []
    for scope in {r[0] for r in rows}:
        own, feed_, lost = sorted((r for r in rows if r[0] == scope), key=lambda r: (r[1], r[2])), [], 0
        for append in sorted({r[1] for r in own}):
            items = [r for r in own if r[1] == append]
            lost += sum(r[9] for r in items if r[4] == "miss")
            items = [r for r in items if r[4] != "miss"]
            if not items:
                continue

            def at(path):
                return next((x for x in reversed(feed_) if x[1] not in ("gap", "reset") and path in (x[2], x[3])), None)  # noqa: B023

            def known(r):
                old = at(r[5])
                if r[4] == "reset":
                    return bool(feed_) and feed_[-1][1] == "reset" and not lost  # noqa: B023
                if old is None or old[1] != r[4]:
                    return False
                if r[4] == "moved":
                    return old[3] == r[6] and at(r[6]) is old
                return old[5] == r[8] if r[4] == "deleted" else old[4] == r[7]

            kept = [r for r in items if not (r[10] and known(r))]
            lines = [(append, "gap", None, None, None, None, "write_failed", lost)] if lost else []
            lost = 0
            lines += [(append, r[4], None if r[4] == "reset" else r[5], r[6] if r[4] == "moved" else None, r[7], r[8], None, None) for r in kept[: most or None]]
            if most and len(kept) > most:
                lines.append((append, "gap", None, None, None, None, "pass_overflow", len(kept) - most))
            feed_ += lines
        out += [(scope, k + 1, *x) for k, x in enumerate(feed_)]
    return sorted(out, key=str)


SCHEMA = "scope long, append long, item long, items long, kind string, path string, from_path string, hash string, reason string, count long, quiet boolean"


@pytest.mark.parametrize("seed,most", [(1, 0), (2, 2)])
def test_any_cut_and_restart_gives_one_feed(spark, seed, most):
    draw = random.Random(seed)
    rows = log(draw)
    want = plain(rows, most)
    for cuts in (1, 3):
        mixed = draw.sample(rows, len(rows)) + draw.sample(rows, 3)  # some rows come twice
        source, folder = scratch(spark, "log"), scratch(spark, "feed")
        size = -(-len(mixed) // cuts)
        for k in range(cuts):  # each round stops the query and starts it again from its checkpoint
            spark.createDataFrame(mixed[k * size : (k + 1) * size], SCHEMA).repartition(2).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            got = feed.record(stream, "scope", folder, most)
        got = [(r.scope, r.seq, r.append, r.kind, r.path, r.from_path, r.hash, r.reason, r.gap_reason, r.gap_count) for r in got.collect()]
        assert sorted(got, key=str) == want
