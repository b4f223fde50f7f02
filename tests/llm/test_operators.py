"""Training-data operators against brute force, the tokenizer libraries and SQL, with nulls, empty tables and clashing names."""

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.llm import bpe, common, op1_quotes, op2_vectors, op3_tokens, op4_lm, op5_exact, op6_language, op7_ngrams, op8_packing, op9_toxicity, op10_codec, queries
from tests.conftest import SMALL
from tests.oracle import compare

WORDS = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said".split()
ODD = ["", None, " ", "a", "<|endoftext|>x<|endoftext|>", "  \n\n x ²³½ 　 日本語 _a_b 1²", "'s 'll don't I'LL", "=" * 5000, "é" * 3000, "x" * 40000, "\x1c\x1d y", "🙂🙂 ok", "a\x0bb\x0cc", "dup", "dup", "dup  ", "dup "]
COLUMNS = "doc_id long, text string, id string, uid long, row int, key string, lang string, source string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"n{i}", i, i, "k", "en" if i % 3 else None, None if i % 4 else "s1.example.org") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, [*range(len(ODD) - 1), None])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_to_sql(spark, name):
    compare(spark, SMALL, queries.queries()[name], queries.oracle_sql()[name])


# 3, 10, 8: the libraries


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts(spark, odd, nothing):
    t = tokenizer()
    got = op3_tokens.token_counts(odd).collect()
    for r, x in zip(got, ODD, strict=True):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((x or "").encode()), n, n > 512)
    assert op3_tokens.token_counts(nothing).count() == 0


def test_codec(spark, odd, nothing):
    e = encoding()
    for r, x in zip(op10_codec.codec_digests(odd).collect(), ODD, strict=True):
        ids = e.encode_ordinary(x or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert op10_codec.codec_digests(nothing).count() == 0
    back = op10_codec.decoded(op10_codec.encoded(odd, "uid"), "uid").collect()
    assert {r.uid: bytes(r.data) for r in back} == {k: (x or "").encode() for k, x in enumerate(ODD)}


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(deadline=None, max_examples=40)
def test_both_merges_agree(texts):
    if not hasattr(test_both_merges_agree, "v"):
        test_both_merges_agree.v = bpe.Vocabulary.of_json(public_tokenizers.path("byte_bpe_50k.json"))
    data = [x.encode() for x in texts]
    a, b = bpe.merged_ragged(test_both_merges_agree.v, data), bpe.merged_padded(test_both_merges_agree.v, data)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_long_pretokens_merge_as_the_library_does():
    v, e = bpe.Vocabulary.of_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), encoding()
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdeghilmnoprstué"), n)) for n in (2, 255, 256, 257, 300, 512, 513, 900, 2000)] + ["=" * 1500, "ab" * 700, "the" * 300]
    ids, n = bpe.merged_padded(v, [x.encode() for x in texts])
    ends = np.cumsum(n)
    for x, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == e._core_bpe.encode_single_piece(x.encode())


def test_store_keeps_no_long_pretokens():
    store = bpe.Store(lambda new: (np.array([len(x) for x in new], np.int32), np.ones(len(new), np.int64)), most=10)
    for k in range(20):
        names = [f"w{k}", "x" * (70 + k), "a", "y" * 65, "x" * (70 + k)]
        at = store.look_up(names)
        assert store.ids[store.starts[at]].tolist() == [len(x) for x in names] and len(store.index) <= 10 and max(map(len, store.index)) <= 64


def test_store_forgets(spark):
    v = bpe.Vocabulary.of_json(public_tokenizers.path("byte_bpe_50k.json"))
    store, split = bpe.Store(lambda new: bpe.merged_ragged(v, [x.encode() for x in new]), most=50), bpe.Splitter(public_tokenizers.PATTERN)
    t = tokenizer()
    for k in range(30):
        text = " ".join(WORDS[k % 7 :: 3]) + f" {k * 7919} word{k}"
        ids, n = bpe.texts_to_ids([text], split, store, None)
        assert ids.tolist() == t.encode(text).ids and n[0] == len(ids)


def test_new_pretokens_reach_the_library_together(monkeypatch):
    import tokenizers

    given, library = [], tokenizer()

    class Library:
        def __init__(self, path):
            self.token_to_id = library.token_to_id

        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(op8_packing, "_STORES", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": Library}))
    split, store, special = op8_packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"q{k}x{n}" for k in range(200)) for n in range(30)] + [x or "" for x in ODD] + ["<|endoftext|", "<|endoftext|<|endoftext|>|>", "<<|endoftext|>"]
    for _ in range(2):
        ids, counts = bpe.texts_to_ids(texts, split, store, (bpe.SPECIAL, special))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert len(given) < 6000 / 50


def test_fast_split_is_that_of_the_pattern():
    safe = [c for c in map(chr, range(0x3100)) if not bpe._UNSAFE.search(c)]
    split = bpe.Splitter(public_tokenizers.PATTERN)
    for x in ["".join(safe), *(f"a{c}{c} {c}1'{c}'s {c}" for c in safe), *(x for x in ODD if x and not bpe._UNSAFE.search(x))]:
        assert bpe._FAST.findall(x) == split.exact.findall(x)


def check_packing(rows, texts, length=1024):
    t = tokenizer()
    total, bins, by_doc = 0, defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        total += r.length
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    for doc, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.length == length or r.piece == 0
    return len(bins), -(-total // length)


def test_packing(spark, nothing):
    rng = np.random.default_rng(0)
    texts = dict(enumerate([*ODD, *(" ".join(rng.choice(WORDS, n)) for n in rng.integers(1, 3000, 200))]))
    n, least = check_packing(op8_packing.packed(docs(spark, list(texts.values()))).collect(), texts)
    assert n <= 1.05 * least + 1
    assert op8_packing.packed(nothing).count() == 0


def test_packing_rounds(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 5000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size int").repartition(8)
    rows = op8_packing.pack(items, per_task=800).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, sizes[r.uid]))
    assert sorted(r.uid for r in rows) == list(range(5000))
    assert all(o == sum(s for p, s in own if p < o) for own in bins.values() for o, _ in own) and max(sum(s for _, s in own) for own in bins.values()) <= 1024
    assert len(bins) <= 1.03 * sum(sizes) / 1024


def test_items_that_never_fit_end(spark):
    items = spark.createDataFrame([(i, 600) for i in range(3000)], "uid long, size int").repartition(8)
    assert op8_packing.pack(items, per_task=500).select("sequence_id").distinct().count() == 3000


# 5


def test_exact_groups(spark, odd, nothing):
    texts, ids = ODD, [*range(len(ODD) - 1), None]
    groups = defaultdict(list)
    for i, x in zip(ids, texts, strict=True):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x or "")].append(i)
    for how in ({}, {"key_bits": 2}, {"key_bits": 1, "capacity": 1}):
        got = op5_exact.exact_groups(odd, **how).collect()
        assert len(got) == len(texts)
        by = {r.doc_id: r for r in got}
        for i, x in zip(ids, texts, strict=True):
            n = re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
            keep = min((k for k in groups[n] if k is not None), default=None)
            assert (by[i].keep_id, by[i].group_size, by[i].kept, by[i].text_sha256) == (keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest())
    assert op5_exact.exact_groups(nothing).count() == 0
    kept = op5_exact.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_repeated_rows_leave_one(spark):
    df = docs(spark, ["same", "same", "same"], [5, 5, 5])
    assert sorted(r.kept for r in op5_exact.exact_groups(df).collect()) == [False, False, True]
    assert op5_exact.without_copies(df).count() == 1


def test_long_chains_go_by_pages(spark):
    texts = spark.createDataFrame([(i, f"t{i % 3}", 7) for i in range(60)], "uid long, text string, key long").withColumnRenamed("key", "key")
    heads = op5_exact._heads(texts.withColumn("bucket", F.lit(1)), 60, page=10).collect()
    assert len(heads) == 60 and len({r.head for r in heads}) == 3 and all((r.head - r.uid) % 3 == 0 for r in heads)


def test_directory_splits():
    rows = {k: 10 for k in range(16)} | {3: 100}
    buckets = op5_exact.directory(rows, rows, 4, 40, 10**9)
    assert buckets[0][0] == 0 and [b[0] for b in buckets] == sorted({b[0] for b in buckets}) and (3, 4) in buckets
    assert sum(1 << (4 - d) for _, d in buckets) == 16


# 2


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [base[k % 30] + rng.normal(scale=0.12, size=8) for k in range(150)]
    rows += [rows[0]] * 5 + [rows[1] * 7.5]
    data = [(i, [float(x) for x in v], "x", i) for i, v in enumerate(rows)]
    data += [(900, None, "x", 0), (901, [], "x", 0), (902, [0.0] * 8, "x", 0), (903, [float("nan")] + [1.0] * 7, "x", 0), (904, [None] + [1.0] * 7, "x", 0), (905, [float("inf")] * 8, "x", 0), (906, [1.0, 2.0], "x", 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, cid string, size int")
    x = np.array(rows)
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (s >= 0.95) & ~np.eye(len(x), dtype=bool)
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.minimum(part, np.where(link, part[None, :], len(x)).min(1))
    for block in (4096, 40):
        got = {r.vec_id: r for r in op2_vectors.near_vectors(df, block_rows=block).collect()}
        assert len(got) == len(data)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), part[i], part[i] == i)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907))
    assert op2_vectors.near_vectors(df.limit(0)).count() == 0


@given(st.lists(st.lists(st.floats(-1, 1), min_size=6, max_size=6).filter(lambda v: max(map(abs, v)) > 1e-3), min_size=2, max_size=12))
@settings(deadline=None)
def test_bounds_hold(vectors):
    u = np.array(vectors)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, scale, length, error = op2_vectors.quantised(u)
    near = (q.astype(float) @ q.astype(float).T) * np.outer(scale, scale)
    bound = np.outer(length, error) + np.outer(error, length) + np.outer(error, error) + 1e-9
    assert (np.abs(u @ u.T - near) <= bound).all()


def test_products_are_exact_at_any_dimension():
    rng = np.random.default_rng(6)
    a, b = rng.choice([-127, 127, 126], (5, 4096)), rng.choice([127, -126], (7, 4096))
    assert (op2_vectors._product(a.astype(np.float32), b.astype(np.float32)) == a @ b.T).all()


def test_joins_of_hot_keys_and_parts(spark):
    left = spark.createDataFrame([(k if k % 3 else 7, k) for k in range(300)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10, 100 if k == 7 else 1) for k in range(0, 300, 2)] + [(7, 70, 101)], "k long, w long, n long").where("k <> 7 OR n > 100")
    got = sorted((r.k, r.v, r.w) for r in common.met(left, right, ["k"], "n", 300, 16).collect())
    assert got == sorted((r.k, r.v, r.w) for r in left.join(right, "k").collect()) and len(got) > 200
    hashed = left.select(F.xxhash64("v").alias("h"), "v")
    sure, rest = common.parted(hashed, "h", hashed.where("v % 50 = 0").select("h"))
    sure, rest = {r.v for r in sure.collect()}, {r.v for r in rest.collect()}
    assert not sure & rest and len(sure | rest) == 301 and {0, 50, 100, 150, 200, 250} <= rest and len(rest) < 20
    assert common.parted(hashed, "h", hashed.limit(0).select("h"))[1].count() == 0


# 7


def shingles(text):
    ws = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_similar(spark, nothing, monkeypatch):
    rng = np.random.default_rng(5)
    texts = list(ODD)
    for k in range(25):
        words = list(rng.choice(WORDS, 120))
        for _ in range(5):
            own = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                own[at] = "zz"
            texts.append(" ".join(own))
    texts += [texts[-1].upper() + "!", "one two", "One, two."]
    sets = [shingles(x) for x in texts]
    n = len(texts)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            link[i, j] = link[j, i] = bool(both) and both >= 0.8 * (len(sets[i] | sets[j])) - 1e-9
    part = np.arange(n)
    for _ in range(n):
        part = np.minimum(part, np.where(link, part[None, :], n).min(1))
    got = {r.doc_id: r for r in op7_ngrams.similar(docs(spark, texts)).collect()}
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), part[i], part[i] == i), texts[i]
        assert got[i].class_id == min([j for j in range(n) if sets[j] == sets[i]] if sets[i] else [i])
    kept = op7_ngrams.without_near_copies(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(n) if part[i] == i] and kept.columns[0] == "doc_id"
    assert op7_ngrams.similar(nothing).count() == 0
    monkeypatch.setattr(op7_ngrams, "TILE", 2)  # groups are cut into tiles
    tiled = {r.doc_id: r.n_links for r in op7_ngrams.similar(docs(spark, texts)).collect()}
    assert tiled == {i: r.n_links for i, r in got.items()}
    monkeypatch.setattr(op7_ngrams, "WIDE", 1)  # and candidate groups by their band buckets
    bucketed = {r.doc_id: (r.n_links, r.component_id) for r in op7_ngrams.similar(docs(spark, texts)).collect()}
    assert bucketed == {i: (r.n_links, r.component_id) for i, r in got.items()}


def test_words_fold_beyond_ascii(spark):
    base = "Ähnliche Straßen führen über Brücken, später „nach Süden“ und weiter – zurück"
    texts = [base, base.upper().replace("STRASSEN", "STRAßEN"), base.replace(" ", "\u3000"), base.replace("–", "-"), "ganz andere Wörter als in allen Texten davor"]
    got = {r.doc_id: r.component_id for r in op7_ngrams.similar(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_bands():
    b = op7_ngrams.bands_for(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.999 > 1 - (1 - 0.8**4) ** (b - 1)


# 1


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nThe second paragraph of it."),
        (1, 1, "assistant", "> Hello there. How\n> are you?\nFine thanks."),
        (1, 2, "user", "On Monday, Bob wrote:\n> > Hello there.\n> > How are you?\n> Fine thanks.\n\nGood."),
        (1, 3, "user", ">> Fine thanks.\n> unknown\nhm"),
        (1, None, "user", None),
        (2, 0, "user", "> The second paragraph of it.\nWhat?"),
        (2, 0, "user", "> The second paragraph of it.\nWhat?"),
        (None, 1, None, ""),
        (3, 0, "user", ">\n> \n"),
        (4, 0, "user", "> Fine thanks.\nYes"),  # too short to be anything's of another conversation
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, mid string")
    got = Counter((r.conv_id, r.turn, r.reply_text, r.n_quoted, r.n_linked, r.link_scope, r.parent_conv, r.parent_turn, r.thread_turn, r.depth) for r in op1_quotes.linked(df).collect())
    assert got == Counter(
        [
            (4, 0, "Yes", 1, 0, None, None, None, 0, 0),
            (1, 0, "Hello there.\nHow are you?\n\nThe second paragraph of it.", 0, 0, None, None, None, 0, 0),
            (1, 1, "Fine thanks.", 1, 1, "conversation", 1, 0, 0, 1),
            (1, 2, "Good.", 2, 2, "conversation", 1, 1, 0, 2),
            (1, 3, "hm", 2, 1, "conversation", 1, 1, 0, 2),
            (1, None, "", 0, 0, None, None, None, None, 0),
            (2, 0, "What?", 1, 1, "corpus", 1, 0, 0, 0),
            (2, 0, "What?", 1, 1, "corpus", 1, 0, 0, 0),
            (None, 1, "", 0, 0, None, None, None, 1, 0),
            (3, 0, "", 0, 0, None, None, None, 0, 0),
        ]
    )
    assert op1_quotes.linked(df.limit(0)).count() == 0


def test_trimmed_quotes(spark):
    rows = [
        (1, 0, "u", "First line here\nsecond line. It has\ntwo sentences!\n\nAnother paragraph"),
        (1, 1, "u", "> second line. It has\none"),
        (1, 2, "u", "> It has two\n> sentences!\ntwo"),
        (1, 3, "u", "> First line here\n> second line. It has\nthree"),
        (1, 4, "u", "> two\n> On Monday, Bob wrote:\n>> It has two sentences!\nfour"),
        (1, 5, "u", "> nobody said so\n> ---\nfive"),
        (2, 0, "u", "> Said twice by different people.\nhm"),
        (2, 1, "u", "Said twice by different people."),
        (3, 0, "u", "Said twice by different people."),
    ]
    got = {(r.conv_id, r.turn): r for r in op1_quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, k].n_linked, got[1, k].parent_turn) for k in range(6)] == [(0, None), (1, 0), (1, 0), (1, 0), (2, 2), (0, None)]
    assert got[1, 4].reply_text == "four" and got[1, 4].n_quoted == 2
    assert (got[2, 0].link_scope, got[2, 0].parent_conv, got[2, 0].parent_turn) == ("corpus", 3, 0)


def test_deep_thread(spark):
    rows = [(1, 0, "u", "start")] + [(1, k, "u", f"> {'start' if k == 1 else f'reply {k - 1}'}\nreply {k}") for k in range(1, 40)]
    got = op1_quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.depth, r.thread_turn) for r in got} == {(k, k, 0) for k in range(40)}


def plain_links(rows):
    """Plain linking: (conv, turn) to (linked passages, link scope, parent) for rows(conv, turn, text) of single-paragraph lines, quoted whole."""
    norm = lambda x: re.sub(r"\s+", " ", x).strip().lower()
    first = {}
    for conv, turn, text in sorted(rows):
        for line in text.split("\n\n"):
            if not line.startswith(">"):
                first.setdefault(norm(line), []).append((conv, turn))
    out = {}
    for conv, turn, text in rows:
        found = {}
        for block in text.split("\n\n"):
            if block.startswith("> "):
                at = first.get(norm(block[2:]), [])
                here = [x for x in at if x[0] == conv and x[1] < turn][:1]
                away = [x for x in at if x[0] != conv and sum(c.isalnum() for c in block) >= op1_quotes.TELLING][:1]
                if here or away:
                    found[norm(block[2:])] = (0, -here[0][1], here[0]) if here else (1, -away[0][1], away[0])
        best = min(found.values(), default=None)
        out[conv, turn] = (len(found), None if best is None else ("conversation", "corpus")[best[0]], best and best[2])
    return out


def test_quotes_equal_a_plain_version(spark):
    rng = np.random.default_rng(12)
    lines = [f"{rng.choice(WORDS)} {rng.choice(WORDS)}  alpha{k}" + " and some more words" * (k % 3 > 0) for k in range(25)]
    rows = []
    for conv in range(12):
        for turn in range(8):
            said, told = rng.choice(lines, 2, replace=False), rng.choice(lines)
            rows.append((conv, turn, f"> {said[0]}\n\n{told}" if rng.random() < 0.7 else str(told)))
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.link_scope, r.n_linked and (r.parent_conv, r.parent_turn) or None) for r in op1_quotes.linked(df).collect()}
    assert got == plain_links(rows)


def test_very_long_message(spark):
    text = "\n".join("" if k % 5 == 4 else ("> " if k % 3 == 0 else "") + f"line number {k}" for k in range(20_000))
    rows = spark.createDataFrame([(1, 0, "u", text), (1, 1, "u", "> line number 7\nok")], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in op1_quotes.linked(rows).collect()}
    assert got[0].n_quoted == 5334 and (got[1].n_linked, got[1].parent_turn) == (1, 0)


# 4


def test_language_model(spark, nothing):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS[:20] if k % 2 else WORDS[20:], 60)) + f" rare{k % 9}" for k in range(150)] + ODD
    got = {r.doc_id: r for r in op4_lm.scored(docs(spark, texts)).collect()}
    tokens = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())] + [b""] for x in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    own = [r for i, r in got.items() if held[i] and i < 150]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    again = {r.doc_id: r.score for r in op4_lm.scored(docs(spark, texts).repartition(7, "uid")).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})  # however rows are dealt
    assert op4_lm.scored(nothing).count() == 0


def test_steps_sort_by_digits_and_shares_of_any_odds(monkeypatch):
    kinds, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **kw: kinds.append((x.dtype.itemsize, kw)) or argsort(x, **kw))
    n = op4_lm.OWN + op4_lm.TAILS
    own = type("Own", (), {"squares": {"q": np.ones(n, np.float32)}, "touched": {"q": np.zeros(n, np.float32)}, "rate": 1.0, "model": type("Model", (), {"arrays": lambda self: arrays})()})()
    arrays = {"q": np.zeros((n, 2), np.float32)}
    op4_lm.Trainer._step(own, "q", np.array([n - 1, 3, n - 1]), np.ones((3, 2), np.float32))
    assert kinds == [(2, {"kind": "stable"})] and own.touched["q"][[3, n - 1]].tolist() == [1, 2]
    assert np.allclose(arrays["q"][[3, n - 1]], -np.array([[1], [2]]) / np.sqrt([[2], [5]])) and (arrays["q"] != 0).sum() == 4
    rng = np.random.default_rng(1)
    for size in (0.1, 3.0, 30.0, 300.0):  # within and beyond what exponentials hold
        h, outputs, at = (rng.normal(0, size, (50, 8)).astype(np.float32), rng.normal(0, 1, (70, 8)).astype(np.float32), rng.integers(0, 70, 50))
        odds = h.astype(float) @ outputs.T.astype(float)
        top = odds.max(1, keepdims=True)
        want = odds[np.arange(50), at] - top[:, 0] - np.log(np.exp(odds - top).sum(1))
        assert np.allclose(op4_lm._log_share(h, outputs, at), want, rtol=1e-4, atol=1e-3)


def test_scores_are_normalised_and_those_of_the_model(spark, monkeypatch):
    """score equals a plain sum over tokens of the trained model's probabilities; those of all symbols after a context sum to one."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, 30)) + f" rare{k}" for k in range(60)] + ["", None, "neverseen"]
    monkeypatch.setattr(op4_lm, "OWN", 20)
    kept, trained = [], op4_lm.trained
    monkeypatch.setattr(op4_lm, "trained", lambda *a: kept.append(trained(*a)) or kept[-1])
    got = {r.doc_id: r for r in op4_lm.scored(docs(spark, texts, [*range(62), None])).collect()}
    (model,) = kept
    lex = model.lexicon
    size = len(lex.share)
    assert size == lex.first[-1] == min(len(lex.n) - 1, max(20, lex.index[b""] + 1)) + op4_lm.TAILS
    for context in ([lex.end, lex.end], [0, 3], [size - 1, 1]):
        log = model.log_probabilities(np.tile(np.array([context], np.int32), (size, 1)), np.arange(size))
        assert np.exp(log).sum() == pytest.approx(1, abs=1e-4)
    counts = Counter(w for i, x in enumerate(texts[:62]) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*op4_lm.tokens(x or ""), b""])
    counts.update([b"neverseen", b""])  # its id is null: it trains
    tail = defaultdict(lambda: [0, 0])
    own = {w for w, k in lex.index.items() if lex.symbol[k] not in lex.tail}
    for w, n in counts.items():
        if w not in own:
            tail[op4_lm.suffix(w)][0] += n
            tail[op4_lm.suffix(w)][1] += 1
    for i in (0, 1, 5, 60, 61, None):
        before, total = [lex.end, lex.end], 0.0
        for w in [*op4_lm.tokens((texts[-1] if i is None else texts[i]) or ""), b""]:
            sym = int(lex.symbol[lex.index[w]]) if w in own else int(lex.tail[op4_lm.suffix(w)])
            h = np.append((model.r[before] * model.c).sum(0), 1)
            g = lex.group[sym]
            odds, inner = model.u @ h, model.q[lex.first[g] : lex.first[g + 1]] @ h
            total += odds[g] - np.log(np.exp(odds).sum()) + inner[sym - lex.first[g]] - np.log(np.exp(inner).sum())
            if w not in own:
                n, v = tail[op4_lm.suffix(w)]
                total += math.log((counts[w] + 1) / (n + v + 1))
            before = [sym, before[0]]
        assert got[i].score == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


# 6


def test_language(spark, nothing):
    de, en = "der die das und nicht sich mit auch schön über straße kleine häuser".split(), WORDS
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice(de if k % 2 else en, 40)), "de" if k % 2 else "en", f"h{k % 5}.example.{'de' if k % 2 else 'org'}") for k in range(200)]
    rows += [(500, " ".join(rng.choice(de, 80)), "en", "h1.example.de"), (501, "", None, None), (502, None, "de", "x.de"), (503, "und", None, "h1.example.de"), (504, "12 34", None, "")]
    df = spark.createDataFrame(rows, "k long, t string, d string, h string")
    got = {r.k: r for r in op6_language.identify(df, F.col("t"), F.col("d"), F.col("h"), ["k"]).collect()}
    assert len(got) == len(rows) and all(got[k].lang == ("de" if k % 2 else "en") and got[k].kept for k in range(200))
    assert got[500].lang == "de" and not got[500].kept and got[502].lang == "de" and got[502].kept
    assert not got[501].kept and got[503].lang == "de" and got[503].kept and not got[504].kept
    assert op6_language.in_known_language(nothing).count() == 0


def test_rare_and_many_languages(spark):
    """A language with a thousandth of the rows, 40 others, and codes that have no model."""
    rng = np.random.default_rng(4)
    word = lambda a: "".join(rng.choice(list(a), 5))
    letters = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9, replace=False) for _ in range(41)]
    own = [[word(a) for _ in range(30)] for a in letters]
    code = lambda k: f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"
    rows = [(f"en{k}", " ".join(rng.choice(WORDS, 8)), "en", "a.org") for k in range(10000)]
    rows += [(f"{code(j)}{k}", " ".join(rng.choice(own[j], 40)), code(j), f"{code(j)}.net") for j in range(41) for k in range(10)]
    rows += [("plain", " ".join(rng.choice(WORDS, 80)), "zz", "b.org"), ("strange", " ".join(word("äöüßñé") for _ in range(60)), "zy", "b.org"), ("void", "", "zx", None), ("wrong", " ".join(rng.choice(WORDS, 80)), code(40), "b.org")]
    df = spark.createDataFrame(rows, "k string, t string, d string, h string")
    got = {r.k: r for r in op6_language.identify(df, F.col("t"), F.col("d"), F.col("h"), ["k"]).collect()}
    assert len(got) == len(rows)
    for j in range(41):
        for k in range(10):
            r = got[f"{code(j)}{k}"]
            assert (r.lang, r.text_lang, r.kept) == (code(j), code(j), True)
    assert got["plain"].lang == "en" and not got["plain"].kept and not got["wrong"].kept
    assert (got["strange"].lang, got["strange"].text_lang, got["strange"].kept) == ("zy", None, True)
    assert (got["void"].lang, got["void"].kept) == ("zx", True)


def test_posteriors_equal_a_plain_version(spark, monkeypatch):
    """lang and prob of every row against plain sums over rows, with ties, repeated rows, empty hosts and texts."""
    from math import exp, log

    monkeypatch.setattr(op6_language, "TRIGRAMS", 10)
    rng = np.random.default_rng(21)
    de, en = "der die das und nicht sich mit auch schön".split(), WORDS[:20]
    rows = [(k, " ".join(rng.choice(de if k % 3 == 0 else en, rng.integers(6, 20))), ["de", "en", None, "en-GB"][k % 4] if k % 3 else "de", ["a.x.org", "b.x.org", "", "c.de"][int(rng.integers(4))]) for k in range(60)]
    rows = [r for r in rows if not (r[0] % 3 and r[2] == "de")] + [(900, "", "en", "a.x.org"), (901, None, None, "c.de"), (901, None, None, "c.de")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, t string, d string, h string, each string")
    got = Counter((r.k, r.lang, round(r.prob, 5)) for r in op6_language.identify(df, F.col("t"), F.col("d"), F.col("h"), ["k"]).collect())

    def grams(text):
        data = (text or "").encode()
        return op6_language.trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()

    code = [re.match("[A-Za-z]*", d or "")[0][:3].lower() for _, _, d, _ in rows]
    names = [c for c, n in sorted(Counter(c for c in code if c).items(), key=lambda x: (-x[1], x[0])) if n >= op6_language.ROWS]
    counts = {c: Counter(g for r, x in zip(rows, code, strict=True) if x == c for g in grams(r[1])) for c in names}
    each = []
    for _, t, _, _ in rows:
        each.append([sum(log((counts[c][g] + 0.5) / (sum(counts[c].values()) + 0.5 * op6_language.BUCKETS)) for g in grams(t)) / 3 for c in names])
    soft = lambda x: [exp(v - max(x)) / sum(exp(w - max(x)) for w in x) for v in x]
    votes = [soft(x) for x in each]
    place = [0 if not c else names.index(c) + 1 for c in code]
    said = [[sum(v[j] for v, p in zip(votes, place, strict=True) if p == d) + 0.5 for j in range(len(names))] for d in range(len(names) + 2)]
    want = Counter()
    for i, (k, _, _, h) in enumerate(rows):
        level = lambda r, n: ".".join(r[3].split(".")[-n:])
        prior = [(sum(v[j] for v in votes) + 20 / len(names)) / (len(rows) + 20) for j in range(len(names))]
        for n in (1, 2):
            own = [x for x, r in enumerate(rows) if level(r, n) == level(rows[i], n) and level(r, 1) == level(rows[i], 1)]
            prior = [(sum(votes[x][j] for x in own) + 20 * prior[j]) / (len(own) + 20) for j in range(len(names))]
        own = [x for x, r in enumerate(rows) if r[3] == h]
        prior = [(max(sum(votes[x][j] for x in own) - votes[i][j], 0) + 20 * prior[j]) / (len(own) - 1 + 20) for j in range(len(names))]
        q = soft([log(prior[j]) + each[i][j] + log(said[place[i]][j] / sum(s[j] for s in said)) for j in range(len(names))])
        want[k, names[q.index(max(q))], round(max(q), 5)] += 1
    assert {(k, c) for k, c, _ in got} == {(k, c) for k, c, _ in want}
    assert sorted(p for *_, p in got.elements()) == pytest.approx(sorted(p for *_, p in want.elements()), abs=2e-5)


def test_pages_and_documents_together(spark):
    html = '<html lang="de"><head><style>p {}</style><script>var x = "the of";</script></head><body><nav>menu</nav><p>Der&nbsp;Text <b>hier</b></p><!-- the --><footer>foot</footer></body></html>'
    page = spark.createDataFrame([(1, "http://user@www.Example.de:80/a?b", html), (2, None, None)], "page_id long, url string, html string")
    assert page.select(op6_language.page_text(F.col("html")).alias("t")).first().t.split() == ["Der", "Text", "hier"]
    found = op6_language.languages_of(docs(spark, ["some text", None]), page).collect()
    assert {(r.doc_id, r.page_id) for r in found} == {(0, None), (1, None), (None, 1), (None, 2)}
    assert [(r.declared, r.host) for r in found if r.page_id == 1] == [("de", "www.example.de")] and [(r.declared, r.host) for r in found if r.page_id == 2] == [(None, None)]


# 9


def test_label_model_finds_accuracies_and_dependence(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    y = rng.random(n) < 0.2
    votes = np.column_stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in ((0.8, 0.02), (0.6, 0.1), (0.5, 0.05), (0.7, 0.2))])
    votes = np.column_stack([votes, np.where(rng.random(n) < 0.95, votes[:, 1], ~votes[:, 1])])  # a voter that copies another
    label = np.where(rng.random(n) < 0.1, np.where(y, 1, 0), 2)
    counts = Counter((tuple(np.flatnonzero(v).tolist()), int(z)) for v, z in zip(votes, label, strict=True))
    keys = {k for k, _ in counts}
    df = spark.createDataFrame([(list(k), counts[k, 0], counts[k, 1], counts[k, 2]) for k in keys], "votes array<int>, n0 long, n1 long, n long")
    model = op9_toxicity.label_model(df, 5)
    assert model.parent[4] == 1 or model.parent[1] == 4
    assert model.given[1, 0].max() == pytest.approx(0.8, abs=0.08) and model.prior[1] == pytest.approx(0.2, abs=0.05)
    q = model.posterior(votes.astype(np.float32))[:, 2]
    assert ((q >= 0.5) == y).mean() > 0.9


def test_a_task_gives_its_sums_of_a_round_in_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(np.flatnonzero(rng.random(12) < 0.3).tolist(), *rng.integers(0, 9, 3).tolist()) for _ in range(400)]
    patterns = spark.createDataFrame(rows, "votes array<int>, n0 long, n1 long, n long").repartition(16).cache()
    made, plain = [], op9_toxicity.in_arrow

    def watched(df, function, schema):
        out = plain(df, function, schema)
        made.append(out.count())
        return out

    want = op9_toxicity.label_model(patterns.coalesce(1), 12)
    monkeypatch.setattr(op9_toxicity, "in_arrow", watched)
    got = op9_toxicity.label_model(patterns, 12)
    assert max(made) <= 16
    monkeypatch.setattr(op9_toxicity, "_SUMS", 7)  # parts that don't divide evenly
    parts = op9_toxicity.label_model(patterns, 12)
    for model in (got, parts):
        assert (model.parent == want.parent).all() and np.allclose(model.given, want.given) and np.allclose(model.prior, want.prior) and np.allclose(model.told, want.told)
    patterns.unpersist()


def test_fit_is_that_of_plain_newton_steps():
    rng = np.random.default_rng(3)
    x = rng.random((200, 6)) < 0.3
    target, weight = rng.random(200), rng.random(200)
    w = op9_toxicity.fitted([np.flatnonzero(r) for r in x], 6, target, weight)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(np.append(x.T @ (weight * (p - target)) + 0.1 * w[:-1], (weight * (p - target)).sum())).max() < 1e-3


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(11)
    texts, labels = [], []
    for k in range(400):
        own = list(rng.choice(WORDS, 50))
        toxic = k % 5 == 1
        if toxic:
            own[3:6] = [f"grumf{'abc'[k % 3]}", "idiot" if k % 2 else "glorb", "grumfix"]
        texts.append(" ".join(own))
        labels.append((k, 0, int(toxic) if k % 10 else None, "x"))
    texts += ODD
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in op9_toxicity.toxicity(docs(spark, texts), marks).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k in range(400) if got[k].held_out]
    assert sum(got[k].predicted == int(k % 5 == 1) for k in held) > 0.95 * len(held)
    assert op9_toxicity.toxicity(nothing, marks).count() == 0
    assert op9_toxicity.toxicity(docs(spark, texts[:5]), marks.limit(0)).count() == 5


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from foliate.session import table

    before = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == before.columns
        rows, left = before.collect(), {r.doc_id for r in after.collect()}
        if name == "toxicity":
            assert left == {r.doc_id for r in op9_toxicity.toxicity(before, table(spark, SMALL, "labels")).collect() if r.score < 0.5} and len(left) < len(rows)
        if name == "language":
            judged = op6_language.identify(before, F.col("text"), F.col("lang"), F.col("source"), ["doc_id"])
            assert left == {r.doc_id for r in judged.collect() if r.kept}
        if name == "exact":
            first = {}
            for r in sorted(rows, key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert left == set(first.values())
        if name == "near":
            sets, gone = {r.doc_id: shingles(r.text) for r in rows}, set()
            part = {i: i for i in sets}
            where = defaultdict(set)
            for i, s in sets.items():
                for g in s:
                    where[g].add(i)
            pairs = {(i, j) for s in where.values() for i in s for j in s if i < j}
            links = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
            for _ in links:
                for i, j in links:
                    part[i] = part[j] = min(part[i], part[j])
            gone = {i for i in part if part[i] != i}
            assert left == set(sets) - gone
        before = spark.createDataFrame([r for r in rows if r.doc_id in left], before.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    n, least = check_packing(out, {r.doc_id: r.text for r in before.collect()})
    assert n <= 1.02 * least + 1
    assert json.dumps([k for k, _ in corpus_pipeline.STAGES])


def test_pipeline_of_an_empty_table(spark, nothing):
    import corpus_pipeline

    docs_ = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, SMALL)
        assert docs_.count() == 0
