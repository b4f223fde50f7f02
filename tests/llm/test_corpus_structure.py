"""Prefix trie, divergence audit and mixing against plain versions, with nulls, ties, long inputs, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliate.llm import op11_trie, op12_divergence, op13_mix

# 11


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    opening = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: tuple(own.get(c - c % 100, [])[: opening[c]] + v[opening[c] :]) for c, v in own.items()}
    members = {p[:d]: sorted(c for c in built if built[c][:d] == p[:d]) for p in built.values() for d in range(len(p) + 1)}
    out = set()
    for node, own in members.items():
        below = [p for p in members if p[: len(node)] == node]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in own if built[c] == node)
        children = sum(len(p) == len(node) + 1 for p in below)
        out.add((own[0], len(node), members[node[:-1]][0] if node else None, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int, base int")
    got = [tuple(r) for r in op11_trie.nodes(df).select(*NODE).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    draw = random.Random(seed)
    rows = []
    for conv in draw.sample(range(100, 420), 120):
        rows += [(conv, t if t else None, draw.choice(["user", None, ""]), draw.choice(["a", "bé", None, "", "🙂x"])) for t in range(draw.choice([1, 2, 3, 7]))]
    draw.shuffle(rows)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_copies_long_conversations_and_orphans(spark):
    rows = [(c, 1, "user", "same") for c in range(100, 400)]  # equal paths fall into many shards
    rows += [(500, t, "user", f"t{t % 3}" * 1000) for t in range(300)] + [(501, t, "user", f"t{t % 3}" * 1000) for t in range(299)]
    rows += [(711, 0, "user", "no first of its family"), (None, 1, "user", "nobody's"), (-50, 1, "x", "y"), (-50, 1, "x", "y")]
    got = found_trie(spark, rows)
    short = [r for r in rows if r[0] not in (500, 501)]
    assert found_trie(spark, short) == plain_trie(short)
    assert max(r[1] for r in got) == 300 and sum(r[1] == 300 for r in got) == 1


def test_trie_of_nothing(spark):
    assert found_trie(spark, []) == set()


def test_splitters_part_paths_and_only_their_starts_span_shards():
    draw = random.Random(5)
    step = lambda x: bytes([x]) * op11_trie.STEP
    rows = [(b"".join(step(draw.randrange(3)) for _ in range(draw.randrange(6))), c, 1) for c in range(400)]
    cuts = op11_trie.splitters(rows, 9)
    spots, parents = op11_trie.skeleton(cuts)
    assert 1 < len(cuts) <= 8 and cuts == sorted(cuts) and all(parents[k] < k for k in range(1, len(parents)))
    starts = {cut[:d] for cut, _ in cuts for d in range(0, len(cut) + 1, op11_trie.STEP)}
    assert len(starts) == len(parents) and len(spots) == len(parents) - 1
    shards = defaultdict(set)
    for path, c, _ in rows:
        for d in range(0, len(path) + 1, op11_trie.STEP):
            shards[path[:d]].add(sum((path, c) >= cut for cut in cuts))
    assert all(len(s) == 1 for node, s in shards.items() if node not in starts)


# 12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
far = lambda p, q: (p - q) ** 2 // (p + q)


def plain_divergences(rows, least=10):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, seen in docs.items():
        kept = [t for t, n in seen.items() if n >= least]
        own = {s: c for (x, s), c in count.items() if x == lang}
        price = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))  # noqa: E731, B023
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = {s: {t: price(c[t], total[s]) for t in kept} for s, c in own.items()}
        q = {t: price(sum(c[t] for c in own.values()), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:10])]
    return sorted(out)


def found_divergences(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, k int, term string, at int")
    return sorted(tuple(r) for r in op12_divergence.divergences(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergences(spark, monkeypatch):
    monkeypatch.setattr(op12_divergence, "BLOCK", 4)  # several blocks and bundles
    monkeypatch.setattr(op12_divergence, "BUNDLE", 2)
    draw = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)] + ["É", "ÉB", "日本", "A", "a", "\x85", "z" * 3000]
    rows = [(" ".join(draw.choices(words, k=draw.choice([0, 1, 5, 60]))), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "ß", None, "s3", "s10", "S"])) for _ in range(300)]
    rows += rows[:20] + [(None, "en", "empty"), ("rare", "xx", "one"), ("rare", "xx", "two"), ("rare", "yy", "alone"), ("1 2 3", None, "digits")]
    got = found_divergences(spark, rows)
    assert got == plain_divergences(rows) and {r[3] for r in got if r[0] == "xx"} == {"one", "two"}


def test_divergences_of_long_texts_and_of_nothing(spark, monkeypatch):
    rows = [("ab cd," * 300_000 + "x" * 5_000_000, "en", f"s{k % 3}") for k in range(2)] + [("ab ef", "en", f"s{k % 3}") for k in range(30)]
    assert found_divergences(spark, rows) == plain_divergences(rows)
    assert found_divergences(spark, []) == []
    data = b"ab cd" * 50
    monkeypatch.setattr(op12_divergence, "PIECE", 7)
    assert b"".join(op12_divergence._pieces(data)) == data
    assert Counter(t for p in op12_divergence._pieces(data) for t in op12_divergence._TERM.findall(p)) == Counter(op12_divergence._TERM.findall(data))


def test_prices_of_huge_counts(spark):
    rows = [(c, n, v) for n, v in ((10**12, 7), (9 * 10**9 + 5, 10**6), (3, 1), (8 * 10**15, 3)) for c in (0, 1, n // 3, n)]
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(op12_divergence.priced(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
    assert [int(op12_divergence.price(np.array([c]), n, v)[0]) for c, n, v in rows] == want


@pytest.mark.parametrize("seed", range(4))
def test_merge_of_two_groups(seed):
    draw, terms = np.random.default_rng(seed), 500
    counts = [np.where(draw.random(terms) < share, draw.integers(1, 9, terms), 0) for share in (0.02, 0.7)]
    a, b = (op12_divergence._Side(np.flatnonzero(c) + (7 << 32), c[c > 0], int(c.sum()), terms) for c in counts)
    want = sum(far(*(1 + 10**9 * (int(c[t]) + 2) // (int(c.sum()) + 2 * terms) for c in counts)) for t in range(terms))
    assert op12_divergence.merged(a, b, terms) == op12_divergence.merged(b, a, terms) == want


# 13

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, copy int, coin string, size string"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: set = set()
    while rest := [s for s in order if s not in full]:
        price = (share * sum(sizes.values()) - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        if not (more := {s for s in rest if price * weight[s] >= most * sizes[s]}):
            break
        full |= more
    return {s: most * sizes[s] if s in full else price * weight[s] for s in order}


def check_mix(spark, rows, near):
    df = spark.createDataFrame([(*r, 1, "c", "s") for r in rows], DOCS)
    got = [tuple(r) for r in op13_mix.mix(df).collect()]
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    want, took = plain_targets(dict(total)), Counter()
    source = {i: s for i, _, s in rows}
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    for i, n, all_, target, taken in got:
        s = source[i]
        assert (n, all_) == (size[i], total[s]) and target == pytest.approx(want[s], abs=1e-9) and taken <= 2 * n and (not n or taken % n == 0)
        took[s] += taken
    assert all(abs(took[s] - want[s]) <= near * want[s] + 1e-9 for s in want)
    assert sorted(got) == sorted(tuple(r) for r in op13_mix.mix(df.repartition(5)).collect())
    return df, got


def test_mix(spark):
    draw = random.Random(1)
    rows = [(k, " ".join("w" * draw.randrange(1, 4) for _ in range(draw.choice([0, 1, 3, 40, 200]))), draw.choice(["a", "b", "é", "Z", None, "", "hot", "hot", "hot"])) for k in range(1500)]
    df, got = check_mix(spark, rows, 0.02)
    often = Counter(r.doc_id for r in op13_mix.mixture(df).select("doc_id").collect())
    assert all(often[i] * n == taken for i, n, _, _, taken in got)
    whole = op13_mix.mixture(df)
    assert whole.columns == [*df.columns, "copy_"]


def test_mix_of_odd_texts(spark):
    odd = [None, "", " \t\n\x0b\x0c\r", "\x1c\x1d a", "é b c", "x" * 9_000_000 + " y", "a b " * 2_500_000, " lead", "trail ", "a\x85b"]
    check_mix(spark, [(k, t, f"s{k}") for k, t in enumerate(odd)] + [(100 + k, "w " * 50_000, "big") for k in range(20)], 1.0)


def test_mix_of_repeated_rows_null_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, "", ""), (1, "a b", "x", 2, "", ""), (None, None, None, 3, "", ""), (None, "a", None, 4, "", "")], DOCS)
    rows = op13_mix.copies(df).collect()
    assert len(rows) == 4 and len({r.taken for r in rows if r.doc_id == 1}) == 1
    assert op13_mix.mix(df.limit(0)).count() == 0 and op13_mix.mixture(df.limit(0)).count() == 0
    only_empty = df.withColumn("text", df.text.substr(1, 0))
    assert {(r.target, r.taken) for r in op13_mix.mix(only_empty).collect()} == {(0.0, 0)}


def test_targets_of_many_sources(spark):
    draw = random.Random(2)
    sizes = {f"s{k}": draw.choice([0, 1, 10, 1000, 10**6]) for k in range(500)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in op13_mix.targets(df).collect()} == want
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
