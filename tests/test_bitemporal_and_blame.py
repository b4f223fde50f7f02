"""Late versions against the chain of all of them, alignment against longest common subsequences, lines followed through versions by a plain walk."""

import random

import pytest

from foliate.operators import bitemporal, blame, feed


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_chain(spark, seed):
    draw = random.Random(seed)
    versions = [(k, t, o, draw.choice(["A", "B", "gone", None])) for k in range(12) for t in draw.sample(range(20), draw.randrange(1, 9)) for o in range(draw.choice([1, 1, 2]))]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, o long, v string")
    draw.shuffle(versions)
    names = ["k", "t", "o", "v"]
    record = bitemporal.recorded(frame(versions[:10]), *names)
    for a in range(10, len(versions), 17):
        late = frame(versions[a : a + 17] + versions[max(0, a - 2) : a])  # some are there already
        record, changed = bitemporal.backfilled(record, late, *names)
        record, before = spark.createDataFrame(record.collect(), record.schema), {tuple(r)[:3]: r for r in record.collect()}
        assert all(before[tuple(r)[:3]][: len(record.columns)] == tuple(r)[: len(record.columns)] for r in changed.collect())
    columns = ["k", "t", "o", "v", "valid_from", "valid_to"]
    got = [tuple(r) for r in bitemporal.intervals(record, "v", "gone").select(*columns).collect()]
    want = [tuple(r) for r in feed.chained(frame(versions), "k", "t", "o", "v", "gone").select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_actions(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, o long, v string")
    names = ["k", "t", "o", "v"]
    record = bitemporal.recorded(frame([(1, 1, 0, "A"), (1, 5, 0, "A"), (2, 4, 0, "B"), (3, 1, 0, "C")]), *names)
    tell = lambda late: {(r.k, r.t): (r.action, r.valid_from, r.valid_to) for r in bitemporal.backfilled(record, frame(late), *names)[1].collect()}
    assert tell([(1, 3, 0, "B")]) == {(1, 3): ("insert", 3, 5), (1, 1): ("close", 1, 3), (1, 5): ("stamp", 5, None)}
    assert tell([(2, 2, 0, "B")]) == {(2, 2): ("insert", 2, None), (2, 4): ("stamp", None, None)}
    assert tell([(1, 2, 0, "A"), (3, 1, 0, "C")]) == {(1, 2): ("repeat", None, None)}
    assert tell([]) == {}


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_alignment():
    draw = random.Random(7)
    for _ in range(300):
        n = draw.randrange(12)
        unique = draw.random() < 0.5
        a = draw.sample("abcdefghijklmnop", n) if unique else draw.choices("ab", k=n)
        b = draw.sample("abcdefghijklmnop", draw.randrange(12)) if unique else draw.choices("ab", k=draw.randrange(12))
        got = blame.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y for x, y in zip(got, got[1:], strict=False))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert len(got) == longest(a, b) if unique else len(got) <= longest(a, b)
    assert blame.aligned([], ["a"]) == [] and len(blame.aligned(["x"] * 3000, ["x"] * 2999 + ["y"])) == 2999


def test_moved_blocks_keep_their_origin():
    block = "a line with more than twenty letters in it\n  short\nand another one of those long lines here"
    assert blame.followed("top\nmiddle\n" + block, block.replace("  short", "\tshort") + "\ntop\nnew") == [2, 3, 4, -1, -1]  # a short line is followed only beside a moved one
    assert blame.followed("", "") == [0] and blame.followed("a", "b") == [-1]


def test_origins_through_versions(spark):
    draw = random.Random(3)
    versions, want = [], {}
    for path in ["a", "b", None]:
        lines, born = [], []
        for at in range(draw.randrange(1, 9)):
            for _ in range(draw.randrange(3)):
                k = draw.randrange(len(lines) + 1)
                lines.insert(k, f"line {path} {at} {draw.random()} with enough letters")
                born.insert(k, at)
            if lines and draw.random() < 0.4:
                k = draw.randrange(len(lines))
                del lines[k], born[k]
            if len(lines) > 2 and draw.random() < 0.5:  # the first line moves to the end
                lines.append(lines.pop(0))
                born.append(born.pop(0))
            if not lines:
                lines, born = ["first of all its lines, long enough"], [at]
            versions.append((path, at, "\n".join(("  " * draw.randrange(2)) + x for x in lines), "z"))
        want |= {(path, k): b for k, b in enumerate(born)}
    df = spark.createDataFrame(versions, "path string, at long, body string, v string")
    got = blame.origins(df, "path", "at", "body").collect()
    assert len(got) == len(want) and {(r.path, r.line): r.since for r in got} == want
    assert blame.origins(df.limit(0), "path", "at", "body").count() == 0


def test_porcelain(spark):
    sha = "0123456789abcdef" * 2 + "01234567"
    head = lambda n, extra="": f"{sha} {n} {n} 1\nauthor A B\nauthor-mail <a@b.c>\nauthor-time 1700000000\nauthor-tz +0100\n{extra}filename x/y.md\n"
    text = head(1) + "\t# Title\n" + head(2, "boundary\n") + "\t\n" + f"{sha} 3 7\nfilename z\n\tauthor nobody\tx\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "fatal: no such path")], "id int, record string")
    rows = blame.porcelain(df, "record").orderBy("line").collect()
    assert [(r.line, r.text, r.author, r.mail, r.origin) for r in rows] == [(1, "# Title", "A B", "a@b.c", "x/y.md"), (2, "", "A B", "a@b.c", "x/y.md"), (7, "author nobody\tx", None, None, "z")]
    assert rows[0].commit == sha and rows[0].at.timestamp() == 1700000000 and rows[2].at is None
