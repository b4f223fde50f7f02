"""Block structure of Markdown notes: fences, indented code, lists, headings, sections, and chunks cut along them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.session import ship

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)")

#: Characters of a chunk's least length, of the stretch before a window's end that is searched for a place to cut, and of the parts of a prefix.
LEAST, LOOK_BACK, COMPONENT, PREFIX, HEADING = 200, 200, 80, 300, 200


@dataclass
class Heading:
    depth: int
    text: str
    line: int
    start: int  # of its line
    body: int  # what follows its line
    end: int = 0  # of its own text: the next heading of any depth
    last: int = 0  # of its body: the next heading that is not deeper
    over: int = -1  # the heading that encloses it


@dataclass
class Blocks:
    """What a scan found; all offsets are into the text as it was given."""

    fences: list[tuple[int, int]] = field(default_factory=list)
    code: list[tuple[int, int]] = field(default_factory=list)
    items: list[tuple[int, int]] = field(default_factory=list)
    headings: list[Heading] = field(default_factory=list)

    def path(self, k: int) -> list[str]:
        """Texts of a heading and of those that enclose it, outermost first."""
        out: list[str] = []
        while k >= 0:
            out.append(self.headings[k].text)
            k = self.headings[k].over
        return out[::-1]


def scan(text: str) -> Blocks:
    """One pass over the lines of a text with LF line ends, offsets kept.

    A fence ends at a line of at least as many of its signs and nothing else, or at the end of the text. Lines with four columns of white
    space before them are code where they follow a blank line (or nothing, a heading or a fence) outside of lists. A list lasts until a
    line that is neither blank, indented nor an item. Headings are ATX lines outside of both kinds of code.
    """
    found, fence, opened, at = Blocks(), "", 0, 0
    in_list, loose, code = False, True, None  # loose: an indented line here is code
    for number, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        blank, indented = not line.strip(), line.startswith(("    ", "\t"))
        more_code = not fence and indented and not blank and loose and not in_list
        if code and not blank and not more_code:
            found.code.append(code)
            code = None
        if fence:
            if line.strip(" \t" + fence[0]) == "" and (m := _FENCE.match(line)) and len(m[1]) >= len(fence):
                found.fences.append((opened, end))
                fence, loose = "", True
        elif more_code:
            code = (code[0] if code else at, end)
        elif blank:
            loose = True
        elif m := _FENCE.match(line):
            fence, opened = m[1], at
        elif m := _HEADING.match(line):
            found.headings.append(Heading(len(m[1]), m[2] or "", number, at, end))
            in_list, loose = False, True
        elif _ITEM.match(line):
            found.items.append((at, end))
            in_list, loose = True, False
        else:
            in_list, loose = in_list and (line[0] in " \t" or not loose), False
        at = end
    if fence:
        found.fences.append((opened, len(text)))
    if code:
        found.code.append(code)
    enclosing: list[int] = []
    for k, h in enumerate(found.headings):
        while enclosing and found.headings[enclosing[-1]].depth >= h.depth:
            found.headings[enclosing.pop()].last = h.start
        h.over = enclosing[-1] if enclosing else -1
        h.end = found.headings[k + 1].start if k + 1 < len(found.headings) else len(text)
        enclosing.append(k)
    for k in enclosing:
        found.headings[k].last = len(text)
    return found


def selected(blocks: Blocks, selector: str) -> int | None:
    """The heading that a selector means, None without one or with several: `#N` (the Nth, from 1), a text, or `A/B`, a text below others that enclose it."""
    wanted = selector.strip()
    if "/" not in wanted and re.fullmatch(r"#\d+", wanted):
        n = int(wanted[1:])
        return n - 1 if 1 <= n <= len(blocks.headings) else None
    whole = [k for k, h in enumerate(blocks.headings) if h.text.strip() == wanted]
    parts = [p.strip() for p in wanted.split("/")]
    below = [k for k in range(len(blocks.headings)) if [p.strip() for p in blocks.path(k)][-len(parts) :] == parts]
    found = whole or below
    return found[0] if len(found) == 1 else None


class Measure:
    """Collapsed lengths of a text: characters after white space is made single and trimmed, of any stretch in constant time."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        full = ~np.isin(points, [9, 10, 11, 12, 13, 32])
        self.n = len(points)
        self.full = np.r_[full, False]
        self.begins = np.r_[full & np.r_[True, ~full[:-1]], False] if self.n else np.zeros(1, bool)
        self.chars, self.words = (np.r_[0, np.cumsum(x[:-1])] for x in (self.full, self.begins))
        self.starts = np.flatnonzero(self.begins)
        ends = np.flatnonzero(full & np.r_[~full[1:], True]) + 1 if self.n else np.zeros(0, np.int64)
        breaks = np.r_[0, np.cumsum(np.isin(points, [10, 13]))]
        before = np.r_[0, ends[:-1]] if len(ends) else ends
        self.first_of_line = breaks[self.starts] > breaks[before]

    def of(self, a, b):
        """Collapsed length of [a, b), of numbers or arrays."""
        chars = self.chars[b] - self.chars[a]
        cut = self.full[a] & ~self.begins[a]  # a stretch that begins inside a word has that word, too
        return np.where(chars > 0, chars + self.words[b] - self.words[a] + cut - 1, 0)

    def reaching(self, a: int, end: int, length: int) -> int | None:
        """The first place up to `end` before which [a, ...) is so long."""
        k = bisect_left(range(a + 1, end + 1), length, key=lambda p: int(self.of(a, p)))
        return a + 1 + k if k < end - a else None

    def word_from(self, a: int, end: int) -> int | None:
        """The first word's start in [a, end)."""
        k = int(np.searchsorted(self.starts, a))
        return int(self.starts[k]) if k < len(self.starts) and self.starts[k] < end else None


def _cut(t: Measure, a: int, n: int, window: int, least: int) -> int:
    """Where a window from a ends: at the last start of a line in the stretch looked back on, else of a word, else at its limit; each only
    if what is before it is long enough. A window of almost only white space goes on to the next word once it is."""
    limit = a + window
    low, high = np.searchsorted(t.starts, [limit - min(LOOK_BACK, window // 10) + 1, limit + 1])
    near, lines = t.starts[low:high], t.starts[low:high][t.first_of_line[low:high]]
    for p in [*lines[-1:].tolist(), *near[-1:].tolist(), limit]:
        if t.of(a, p) >= least:
            return p
    enough = t.reaching(a, n, least)
    if enough is None:
        return n
    word = t.word_from(max(enough, limit + 1), n)
    return word if word is not None and t.of(a, word) <= window else enough


def _halves(t: Measure, a: int, n: int, window: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """The last two windows over [a, n), of which both are long enough and as equal as can be, where there is a way.

    Better are places where both fit the window, and among these starts of words; of equal ones the first. A rest of at most twice the
    least length is one window if it fits.
    """
    total = int(t.of(a, n))
    if total <= 2 * least and n - a <= window:
        return [(a, n)]
    place = np.arange(a + 1, n)
    left, right = t.of(a, place), t.of(place, n)
    able = (left >= least) & (right >= least)
    fits, word = (place - a <= window) & (n - place <= window), t.begins[place]
    for choice in ((fits & word), fits, word, np.ones(len(place), bool))[: 2 if total <= 2 * least else 4]:
        if (good := able & choice).any():
            cut = int(place[good][np.argmin(np.abs(left - right)[good])])
            break
    else:
        if total <= window:
            return [(a, n)]
        cut = t.reaching(a, n, total // 2) or n
    again = cut
    if overlap:
        back = min(cut, max(cut - overlap, n - window, a + 1))
        again = t.word_from(back, cut + 1) or back
    return [(a, cut), (again, n)]


def windows(t: Measure, a: int, n: int, window: int, least: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of [a, n), each with something but white space; a rest that would be too short is balanced with the window before it."""
    while n - a > window:
        cut = _cut(t, a, n, window, least)
        if cut >= n:
            break
        if least and t.of(cut, n) < least:
            yield from _halves(t, a, n, window, least, overlap)
            return
        if t.of(a, cut):
            yield a, cut
        if overlap:
            back = max(cut - overlap, a + 1)
            a = t.word_from(back, cut + 1) or back
        else:
            a = cut
    if t.of(a, n):
        yield a, n


@dataclass
class Chunk:
    text: str
    start: int  # in the note's body, fences counted
    end: int
    section: int  # number of the heading that holds it from 1, 0 for none
    path: list[str]


def chunked(body: str, window: int = 2048, overlap: int = 0, most: int = 1000) -> tuple[list[Chunk], bool]:
    """(chunks of a note's body, whether more than `most` were left out); most = 0: no cap.

    Fenced code is left out. Sections end at headings of any depth; one that is shorter than the least length (LEAST, at most half a window)
    goes together with those after it until they are long enough, the last one with those before it, heading lines between them included.
    What is too long is cut in windows. A chunk belongs to the deepest heading whose body holds all of it. A body of headings alone, or whose
    text is only long enough as a whole, is one group under no heading. No text, no chunks.
    """
    least = min(LEAST, window // 2)
    blocks = scan(body)
    cuts = [(0, 0), *blocks.fences, (len(body), len(body))]
    kept = [(a, b) for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False) if a < b]
    raw_at, clean_at = [a for a, _ in kept], np.r_[0, np.cumsum([b - a for a, b in kept])].astype(int).tolist()
    clean = "".join(body[a:b] for a, b in kept)
    t = Measure(clean)

    def into(p: int) -> int:
        """Where a place of the body is in the text without fences."""
        k = bisect_right(raw_at, p) - 1
        return 0 if k < 0 else min(clean_at[k] + p - raw_at[k], clean_at[k + 1])

    def back(p: int) -> int:
        k = min(bisect_right(clean_at, p) - 1, len(raw_at) - 1)
        return raw_at[k] + p - clean_at[k]

    first = blocks.headings[0].start if blocks.headings else len(body)
    sections = [(into(a), into(b)) for a, b in [(0, first), *((h.body, h.end) for h in blocks.headings)]]
    sections = [(a, b) for a, b in sections if a < b and t.of(a, b)]
    groups: list[tuple[int, int]] = []
    open_: tuple[int, int] | None = None
    for a, b in sections:
        open_ = (open_[0] if open_ else a, b)
        if t.of(*open_) >= least:
            groups.append(open_)
            open_ = None
    whole = not sections and bool(t.n) and bool(t.of(0, t.n))
    if open_:
        if groups:
            groups[-1] = (groups[-1][0], open_[1])
        elif t.of(0, t.n) < least:
            groups.append(open_)
        else:
            whole = True
    if whole:
        groups = [(0, t.n)]
    bodies = [h.body for h in blocks.headings]
    out: list[Chunk] = []
    for low, high in groups:
        for a, b in windows(t, low, high, window, least, overlap):
            if most and len(out) == most:
                return out, True
            start, end = back(a), back(b - 1) + 1
            k = -1 if whole else bisect_right(bodies, start) - 1
            while k >= 0 and blocks.headings[k].last < end:
                k = blocks.headings[k].over
            out.append(Chunk(clean[a:b], start, end, k + 1, [p[:HEADING] for p in blocks.path(k)]))
    return out, False


def canonical(text: Column) -> Column:
    """LF for all line ends, no NUL."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\u0000", "")


def chunks(df: DataFrame, id_col: str, text_col: str, window: int = 2048, overlap: int = 0, most: int = 1000) -> DataFrame:
    """(id, chunk, start, end, section, path, body, cut) of every chunk of every text; cut: chunks over `most` were left out. Null text has none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found, cut = chunked(text, window, overlap, most)
                rows += [(k, n, c.start, c.end, c.section, c.path, c.text, cut) for n, c in enumerate(found)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int32()] * 4 + [pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["id", "chunk", "start", "end", "section", "path", "body", "cut"])

    ship(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, chunk int, start int, end int, section int, path array<string>, body string, cut boolean")
    return out.withColumnRenamed("id", id_col)


def outline(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, depth, heading, path, start, size) of every section: from the first character of its heading's line to the next heading that isn't deeper."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                blocks = scan(text)
                rows += [(k, n + 1, h.depth, h.text, blocks.path(n), h.start, h.last - h.start) for n, h in enumerate(blocks.headings)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
            yield pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["id", "ordinal", "depth", "heading", "path", "start", "size"])

    ship(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, ordinal int, depth int, heading string, path array<string>, start int, size int")
    return out.withColumnRenamed("id", id_col)


def prefix(title: Column, path: Column, tags: Column | None = None) -> Column:
    """What a chunk is read under: `title > h1 > ... > hk`, each part with single spaces and at most COMPONENT characters.

    Over PREFIX characters the outermost headings become one `…`, as few as must; title and innermost heading stay. A line of tags follows
    if all of it still fits.
    """
    part = lambda c: F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(COMPONENT))
    heads = F.transform(F.coalesce(path, F.array().cast("array<string>")), part)
    without = lambda k: F.array_join(F.concat(F.array(part(title)), F.when(k > 0, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")), F.slice(heads, k + 1, F.size(heads))), " > ")
    tried = F.transform(F.sequence(F.lit(0), F.greatest(F.size(heads) - 1, F.lit(0))), without)
    line = F.coalesce(F.try_element_at(F.filter(tried, lambda x: F.length(x) <= PREFIX), F.lit(1)), F.try_element_at(tried, F.lit(-1)))
    if tags is None:
        return line
    more = F.concat(line, F.lit("\ntags: "), F.array_join(tags, ", "))
    return F.when((F.size(tags) > 0) & (F.length(more) <= PREFIX), more).otherwise(line)
