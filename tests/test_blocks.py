"""Block structure and chunks of Markdown against plain versions on random notes, and by hand at their edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliate.operators import blocks, parsing, upkeep

SPACE = "\t\n\x0b\x0c\r "


def length(text):
    return len(re.sub(f"[{SPACE}]+", " ", text).strip(" "))


def words(text, a, b):
    """Starts of words in [a, b)."""
    return [p for p in range(a, min(b, len(text))) if text[p] not in SPACE and (p == 0 or text[p - 1] in SPACE)]


def opens_line(text, p):
    q = p
    while q > 0 and text[q - 1] in SPACE:
        q -= 1
    return "\n" in text[q:p]


def plain_cut(t, a, window, least):
    limit = a + window
    starts = words(t, limit - min(200, window // 10) + 1, limit + 1)
    lines = [p for p in starts if opens_line(t, p)]
    for p in [*lines[-1:], *starts[-1:], limit]:
        if length(t[a:p]) >= least:
            return p
    for p in range(limit, len(t) + 1):
        if length(t[a:p]) >= least:
            first = p
            break
    else:
        return len(t)
    later = words(t, max(first, limit + 1), len(t))
    return later[0] if later and length(t[a : later[0]]) <= window else first


def plain_halves(t, a, window, least, overlap):
    n = len(t)
    total = length(t[a:])
    if total <= 2 * least and n - a <= window:
        return [(a, n)]
    ways = []
    for p in range(a + 1, n):
        left, right = length(t[a:p]), length(t[p:])
        if left >= least and right >= least:
            fits, word = p - a <= window and n - p <= window, p in words(t, p, p + 1)
            tier = 0 if fits and word else 1 if fits else 2 if word else 3
            if tier < 2 or total > 2 * least:
                ways.append((tier, abs(left - right), p))
    if ways:
        cut = min(ways)[2]
    elif total <= window:
        return [(a, n)]
    else:
        cut = next(p for p in range(a + 1, n + 1) if length(t[a:p]) >= total // 2)
    again = cut
    if overlap:
        back = min(cut, max(cut - overlap, n - window, a + 1))
        again = (words(t, back, cut + 1) or [back])[0]
    return [(a, cut), (again, n)]


def plain_windows(t, window, least, overlap):
    a, out = 0, []
    while len(t) - a > window:
        cut = plain_cut(t, a, window, least)
        if cut >= len(t):
            break
        if least and length(t[cut:]) < least:
            return out + plain_halves(t, a, window, least, overlap)
        if length(t[a:cut]):
            out.append((a, cut))
        a = (words(t, max(cut - overlap, a + 1), cut + 1) or [max(cut - overlap, a + 1)])[0] if overlap else cut
    return out + ([(a, len(t))] if length(t[a:]) else [])


def plain_chunks(body, window, overlap):
    """Texts and section numbers of the chunks; fences by a plain reading of the lines."""
    least, fence, kept, at, heads = min(200, window // 2), None, [], 0, []
    for line in body.splitlines(keepends=True):
        bare = line.rstrip("\n")
        if fence:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", bare):
                fence = None
        elif m := re.match(r" {0,3}(```+(?!.*`)|~~~+)", bare):
            fence = m[1]
        else:
            if m := re.match(r" {0,3}(#{1,6})([ \t].*)?$", bare):
                heads.append((at, at + len(line), len(m[1])))
            kept += range(at, at + len(line))
        at += len(line)
    clean, place = "".join(body[p] for p in kept), kept
    bounds = [(0, heads[0][0] if heads else len(body))] + [(h[1], heads[k + 1][0] if k + 1 < len(heads) else len(body)) for k, h in enumerate(heads)]
    own = lambda a, b: [k for k, p in enumerate(place) if a <= p < b]
    spans = [(s[0], s[-1] + 1) for a, b in bounds if (s := own(a, b)) and length(clean[s[0] : s[-1] + 1])]
    groups, k = [], 0
    while k < len(spans):
        a, b = spans[k]
        while length(clean[a:b]) < least and k + 1 < len(spans):
            k += 1
            b = spans[k][1]
        k += 1
        groups.append((a, b))
    whole = not spans and length(clean) > 0
    if groups and length(clean[slice(*groups[-1])]) < least:
        if len(groups) > 1:
            groups[-2:] = [(groups[-2][0], groups[-1][1])]
        elif length(clean) >= least:
            whole = True
    out = []
    for a, b in [(0, len(clean))] if whole else groups:
        for x, y in plain_windows(clean[a:b], window, least, overlap):
            low, high = place[a + x], place[a + y - 1] + 1
            holds = []
            for n, (_, start, depth) in enumerate(heads):
                end = next((h[0] for h in heads[n + 1 :] if h[2] <= depth), len(body))
                if start <= low and high <= end:
                    holds.append(n + 1)
            out.append((clean[a + x : a + y], low, high, 0 if whole or not holds else holds[-1]))
    return out


def note(draw):
    parts = []
    for _ in range(draw.randrange(1, 12)):
        kind = draw.random()
        if kind < 0.3:
            parts.append("#" * draw.randrange(1, 5) + draw.choice([" ", "  ", ""]) + draw.choice(["A", "B c", "Ünï", ""]))
        elif kind < 0.42:
            parts.append(draw.choice(["```", "~~~~", "```py"]) + "\n" + draw.choice(["code # x", "# no heading\n\n", ""]) + draw.choice(["\n```", "\n~~~~", "\n~~~~~", ""]))
        elif kind < 0.5:
            parts.append(draw.choice(["", " ", "\t", " " * 40, "\n" * 30]))
        else:
            parts.append(draw.choice([" ", "\n", "  \n "]).join("".join(draw.choices("abcé", k=draw.choice([1, 2, 5, 9, 70]))) for _ in range(draw.choice([1, 5, 20, 80]))))
    return draw.choice(["\n", "\n\n"]).join(parts)


@pytest.mark.parametrize("window,overlap", [(40, 0), (40, 9), (120, 30), (600, 0)])
def test_chunks_equal_plain_version(window, overlap):
    draw = random.Random(window + overlap)
    for _ in range(150):
        body = note(draw)
        got, cut = blocks.chunked(body, window, overlap, 0)
        assert [(c.text, c.start, c.end, c.section) for c in got] == plain_chunks(body, window, overlap), body
        assert not cut
        few, cut = blocks.chunked(body, window, overlap, 2)
        assert [c.text for c in few] == [c.text for c in got[:2]] and cut == (len(got) > 2)


def test_chunks_of_a_table(spark):
    long = "# T\n" + "word " * 100_000
    df = spark.createDataFrame([(1, "# A\r\n" + "x" * 300 + "\r\n## B\r\ny\x00"), (2, None), (3, "```\nall code\n```"), (4, "# only\n## heads"), (5, long), (5, long)], "id int, text string")
    rows = blocks.chunks(df, "id", "text", 2000, 0, 50).orderBy("id", "chunk").collect()
    assert [(r.id, r.section, r.path, r.cut) for r in rows if r.id < 5] == [(1, 1, ["A"], False), (4, 0, [], False)]
    assert rows[0].body.endswith("## B\ny") and sum(r.id == 5 for r in rows) == 100 and all(r.cut for r in rows if r.id == 5)
    lengths = upkeep.chunk_lengths(blocks.chunks(df, "id", "text", 2000), "id", parsing.collapsed_length(F.col("body")), 200).collect()[0]
    assert (lengths.n, lengths.under, lengths.notes, lengths.notes_under) == (2 + 2 * 250, 1, 3, 1)
    values = sorted(length(c.text) for c in [*blocks.chunked(df.collect()[0].text.replace("\r\n", "\n").replace("\0", ""), 2000)[0], *blocks.chunked("# only\n## heads", 2000)[0], *2 * blocks.chunked(long, 2000)[0]])
    assert [lengths[f"d{k}"] for k in range(1, 10)] == [values[-(-k * len(values) // 10) - 1] for k in range(1, 10)]


def test_scan():
    text = "para\n    not code\n\n    code\n\n    more\n- item\n\n    in the list\n\nout\n\n\tcode # x\n# H\n    code again\n```\n# no\n"
    found = blocks.scan(text)
    assert [text[a:b] for a, b in found.code] == ["    code\n\n    more\n", "\tcode # x\n", "    code again\n"]
    assert [text[a:b] for a, b in found.fences] == ["```\n# no\n"] and [h.text for h in found.headings] == ["H"]
    assert [text[a:b] for a, b in found.items] == ["- item\n"]


def test_selectors():
    found = blocks.scan("# A\n## B\n# C\n## B\n### D #\n## E/F\n")
    pick = lambda s: blocks.selected(found, s)
    assert (pick("#2"), pick("#9"), pick("B"), pick("C/B"), pick("C/B/D"), pick("D"), pick("A/D"), pick("E/F"), pick("")) == (1, None, None, 3, 4, 4, None, 5, None)
    assert [found.path(k) for k in (1, 4)] == [["A", "B"], ["C", "B", "D"]] and blocks.selected(blocks.scan(""), "#1") is None


def test_outline_and_prefix(spark):
    df = spark.createDataFrame([(1, "x\n# A\ny\n## B\nz\n# C"), (2, None)], "id int, text string")
    assert [tuple(r)[1:] for r in blocks.outline(df, "id", "text").collect()] == [(1, 1, "A", ["A"], 2, 13), (2, 2, "B", ["A", "B"], 8, 7), (3, 1, "C", ["C"], 15, 3)]
    rows = [("T  t", ["a", "b"], ["x"]), ("T", ["h" * 90] * 5, ["x"]), (None, None, None), ("T", ["a"], ["t" * 300])]
    df = spark.createDataFrame(rows, "title string, path array<string>, tags array<string>")
    got = [r[0] for r in df.select(blocks.prefix(F.col("title"), F.col("path"), F.col("tags"))).collect()]
    assert got == ["T t > a > b\ntags: x", " > ".join(["T", "…", *["h" * 80] * 3]) + "\ntags: x", "", "T > a"]


def test_tags():
    tags = lambda text: parsing.parse(text)["tags"]
    assert tags("[Jump](#heading) (#no) x#no #yes\n#1a2b #aaaa #fff #12 #a1b2c3 #facade #- #p/q/") == ["1a2b", "aaaa", "facade", "p/q", "yes"]
    assert tags("x\n\n    #include\n\n- a\n    - #child") == ["child"]


def test_links():
    kinds = lambda text: [(k, t) for k, t, _ in parsing.links(text)]
    assert kinds("[[a#b|c]] ![[p.png]] [t](<u v.md>) [t](x_(y).md) ![i](z.png \"T\") [t](a b) [[no\n]] [[x [[y]] [a [b](c)") == [
        ("link", "a"), ("embed", "p.png"), ("markdown", "u v.md"), ("markdown", "x_(y).md"), ("embed", "z.png"), ("link", "y"), ("markdown", "c")]
    assert kinds("[[" * 200_000 + "]" * 3) == [("link", "")] and kinds("[" * 300_000 + "](" * 2) == []
