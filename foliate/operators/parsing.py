"""Parsing of Markdown notes: front matter, tags, links, headings, tasks and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.operators.blocks import Blocks, canonical, scan
from foliate.session import ship

_TAG = re.compile(r"(?:^|(?<=\s))#([\w/\-]+)")
_TASK = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\[(.)\]\s+(.*)$")


def collapsed_length(text: Column) -> Column:
    """Characters after white space is made single and trimmed."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\x0b\f\r ]+", " ")))


def is_tag(tag: str) -> bool:
    """Has a letter or digit or _, is no number, and not the code of a colour (3, 6 or 8 hex digits with a decimal one, or one repeated)."""
    if not re.search(r"\w", tag) or tag.isdigit():
        return False
    colour = len(tag) in (3, 6, 8) and re.fullmatch(r"[0-9a-fA-F]+", tag)
    return not (colour and (re.search("[0-9]", tag) or len(set(tag.lower())) == 1))


def partition(text: str) -> tuple[dict[str, object], str]:
    """(front matter, body). Keys with scalar or list values are read; a block that isn't closed or holds another line leaves all as body."""
    lines = re.split(r"\r\n|\r|\n", text)
    if lines[0].rstrip() != "---":
        return {}, text
    found: dict[str, object] = {}
    key = None
    for k, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            return found, "\n".join(lines[k + 1 :])
        if m := re.match(r"^([\w\- ]+):\s*(.*)$", line):
            key, value = m[1].strip(), m[2].strip()
            inner = re.fullmatch(r"\[(.*)\]", value)
            found[key] = [x.strip().strip("'\"") for x in inner[1].split(",") if x.strip()] if inner else value.strip("'\"")
        elif (m := re.match(r"^\s*-\s+(.*)$", line)) and key is not None:
            have = found[key]
            found[key] = [*(have if isinstance(have, list) else [have] if have else []), m[1].strip().strip("'\"")]
        elif line.strip() and not line.lstrip().startswith("#"):
            return {}, text
    return {}, text


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces for all of the spans but their line ends; every offset stays."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def masked(body: str, blocks: Blocks | None = None) -> str:
    """The body with fenced and inline code and %%comments%% blanked, every offset kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    clean = blanked(body, (blocks or scan(body)).fences)
    return re.sub(r"%%.*?%%", blank, re.sub(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)", blank, clean), flags=re.S)


class _Next:
    """The next place of a sign from ever later places, looked for once."""

    def __init__(self, text: str, sign: str) -> None:
        self.text, self.sign, self.at = text, sign, -2

    def from_(self, p: int) -> int:
        if self.at != -1 and self.at < p:
            self.at = self.text.find(self.sign, p)
        return self.at if self.at >= 0 else len(self.text)


def links(clean: str) -> list[tuple[str, str, int]]:
    """(kind, target, place) of the links of a masked text in order: `[[target#part|name]]`, `[name](target "title")`, `[name](<a target>)`.

    kind is link, markdown, or embed after a `!`. A link ends on its line; an inner `[[` begins anew. Each sign is looked for once from
    left to right, so the work is linear in the text, whatever is left open in it.
    """
    out: list[tuple[str, str, int]] = []
    line, double, single, angle = (_Next(clean, s) for s in ("\n", "]]", "]", ">"))
    at = clean.find("[")
    while at >= 0:
        stop, after = line.from_(at), at + 1
        embed = at > 0 and clean[at - 1] == "!"
        if clean.startswith("[[", at):
            close = double.from_(at + 2)
            inner = clean.find("[", at + 2, min(close, stop))
            if close < stop and inner < 0:
                out.append(("embed" if embed else "link", clean[at + 2 : close].split("|")[0].split("#")[0].strip(), at))
                after = close + 2
            elif inner >= 0:
                after = inner
        else:
            close = single.from_(at + 1)
            inner = clean.find("[", at + 1, min(close, stop))
            if close < stop and inner < 0 and clean.startswith("(", close + 1):
                target, end = _destination(clean, close + 2, stop, angle)
                if target:
                    out.append(("embed" if embed else "markdown", target, at))
                    after = end
                else:
                    after = close + 2
            elif inner >= 0:
                after = inner
        at = clean.find("[", after)
    return out


def _destination(text: str, at: int, stop: int, angle: _Next) -> tuple[str, int]:
    """(what stands in the brackets of a link, where they end); empty without one. Brackets inside of it must be paired."""
    if text.startswith("<", at):
        close = angle.from_(at)
        end = text.find(")", close, stop) if close < stop else -1
        return (text[at + 1 : close].strip(), end + 1) if end >= 0 else ("", at)
    depth = 0
    for p in range(at, stop):
        if text[p] == "(":
            depth += 1
        elif text[p] == ")":
            if depth == 0:
                target, _, title = text[at:p].strip().partition(" ")
                return (target, p + 1) if not title or title.strip()[0] in "\"'(" else ("", at)
            depth -= 1
    return "", at


def parse(text: str) -> dict[str, list]:
    """Tags (sorted), links, headings and tasks of one note. Indented code has no tags; links and tasks in it count, as lists look alike."""
    front, body = partition(text)
    blocks = scan(body)
    clean = masked(body, blocks)
    own = front.get("tags", front.get("tag", []))
    own = re.split(r"[,\s]+", own) if isinstance(own, str) else own
    tags = sorted({t.strip("#/") for t in [*own, *_TAG.findall(blanked(clean, blocks.code))] if is_tag(t.strip("#/"))})
    headings = [(h.depth, h.text, h.line) for h in blocks.headings]
    tasks, under, at = [], -1, 0
    for n, (line, raw) in enumerate(zip(clean.split("\n"), body.split("\n"), strict=True)):
        while under + 1 < len(blocks.headings) and blocks.headings[under + 1].start <= at:
            under += 1
        at += len(raw) + 1
        if (m := _TASK.match(line)) and (own_line := _TASK.match(raw)):
            state = "done" if m[1] in "xX" else "cancelled" if m[1] == "-" else "open"
            due = re.findall(r"\U0001F4C5\s*(\d{4}-\d{2}-\d{2})", raw)
            tasks.append((n, state, own_line[2], due[-1] if due else None, " > ".join(blocks.path(under))))
    return {"tags": tags, "links": [(kind, target) for kind, target, _ in links(clean)], "headings": headings, "tasks": tasks}


_SCHEMA = "tags array<string>, links array<struct<kind:string,target:string>>, headings array<struct<depth:int,text:string,line:int>>, tasks array<struct<line:int,state:string,text:string,due:string,heading:string>>"


def markdown(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tags, links, headings, tasks) of every note, parsed in Arrow batches. Null text is an empty note."""
    kind = df.schema[id_col].dataType.simpleString()
    struct = lambda **f: pa.list_(pa.struct(list(f.items())))
    types = {
        "tags": pa.list_(pa.string()),
        "links": struct(kind=pa.string(), target=pa.string()),
        "headings": struct(depth=pa.int32(), text=pa.string(), line=pa.int32()),
        "tasks": struct(line=pa.int32(), state=pa.string(), text=pa.string(), due=pa.string(), heading=pa.string()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) for x in batch.column(1).to_pylist()]
            columns = []
            for name, t in types.items():
                names = [f.name for f in t.value_type] if pa.types.is_struct(t.value_type) else None
                columns.append(pa.array([[dict(zip(names, x, strict=True)) for x in r[name]] if names else r[name] for r in rows], t))
            yield pa.record_batch([batch.column(0), *columns], ["id", *types])

    ship(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("text")).mapInArrow(run, f"id {kind}, {_SCHEMA}")
    return out.withColumnRenamed("id", id_col)
