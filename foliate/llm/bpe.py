"""Byte-level BPE in numpy: pair tables, two ways of merging, and a bounded store of pre-tokens already encoded.

Vocabularies are read from the files of public tokenizers, by path; nothing is trained here.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import regex

from foliate.llm.common import ragged

NONE = np.int32(2**31 - 1)
#: Texts merged together: their arrays stay in the processor's cache.
CHUNK = 8192
#: Cells of a line: texts of more symbols take several lines.
FOLD = 256
SPECIAL = "<|endoftext|>"

#: The same split as public_tokenizers.PATTERN by the faster standard module, for texts of which every character
#: is of a block where both modules agree on letters, numbers and white space.
#: Letters are listed, which is faster than telling them by classes; they come first, as no other choice begins with one.
_SAFE = "\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00b1\\u00b4-\\u00b8\\u00ba\\u00bb\\u00bf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf"
_LETTERS = "".join(c for c in map(chr, range(0x20C0)) if re.fullmatch(rf"(?=[{_SAFE}])[^\W\d_]", c))
_FAST = re.compile(rf""" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+""")
_UNSAFE = re.compile(f"[^{_SAFE}]")


class Splitter:
    """Splits a text into the pre-tokens of a pattern."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (self.exact if _UNSAFE.search(text) else _FAST).findall(text)


class Pairs:
    """Ranks of mergeable pairs in an open-addressing hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
        size = 1 << self.bits
        self.key = np.full(size, np.uint64(2**64 - 1))
        self.rank, self.merged = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        keys, todo, self.probes = self._keys(left, right), np.arange(len(left)), 0
        slot = self._slot(keys)
        while len(todo):
            at = (slot[todo] + self.probes) & (size - 1)
            free = self.key[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = todo[free & first]
            at = at[free & first]
            self.key[at], self.rank[at], self.merged[at] = keys[put], rank[put], merged[put]
            todo = todo[~(free & first)]
            self.probes += 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of every pair; NONE and -1 where it can't be merged."""
        keys = self._keys(left, right)
        slot, size = self._slot(keys), len(self.key)
        have = self.key[slot]
        hit = have == keys
        rank, merged = np.where(hit, self.rank[slot], NONE), np.where(hit, self.merged[slot], -1)
        todo = np.flatnonzero(~hit & (have != np.uint64(2**64 - 1)))
        keys, slot = keys[todo], slot[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot = (slot + 1) & (size - 1)
            have = self.key[slot]
            hit = have == keys
            rank[todo[hit]], merged[todo[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (have != np.uint64(2**64 - 1))
            todo, keys, slot = todo[on], keys[on], slot[on]
        return rank, merged


class Vocabulary:
    """Ids of single bytes, mergeable pairs, and the bytes of every id."""

    def __init__(self, tokens: dict[bytes, int], pairs: list[tuple[int, int, int, int]]):
        left, right, rank, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pairs = Pairs(left, right, rank.astype(np.int32), merged.astype(np.int32))
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_of[i] = token

    @classmethod
    def of_json(cls, path: str) -> Vocabulary:
        """From a file of the tokenizers library with byte-level BPE."""
        model = json.load(open(path, encoding="utf-8"))["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = {bytes(map(back.__getitem__, token)): i for token, i in model["vocab"].items()}
        vocab = model["vocab"]
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        return cls(ids, [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)])

    @classmethod
    def of_ranks(cls, path: str) -> Vocabulary:
        """From a file of ranks of the tiktoken library: any two tokens that make a token can be merged."""
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pairs = [(ids[token[:k]], ids[token[k:]], rank, rank) for token, rank in ids.items() for k in range(1, len(token)) if token[:k] in ids and token[k:] in ids]
        return cls(ids, pairs)


def merged_ragged(vocabulary: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging: (ids of all texts end to end, number of ids of each).

    In every round each sequence merges all occurrences of its lowest-rank pair at once, from left to
    right where they overlap. A sequence without a mergeable pair leaves the arrays.
    """
    if len(texts) > CHUNK:
        parts = [merged_ragged(vocabulary, texts[k : k + CHUNK]) for k in range(0, len(texts), CHUNK)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = vocabulary.byte[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.flatnonzero(lengths)
    lengths = lengths[owner]
    rank, merged = np.full(len(symbols), NONE, np.int32), np.full(len(symbols), -1, np.int32)
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(lengths) - 1] = False
    stale = np.flatnonzero(inner)  # pairs of which the rank isn't known
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(owner):
        rank[stale], merged[stale] = vocabulary.pairs.find(symbols[stale], symbols[stale + 1])
        least = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
        active = least != NONE
        if not active.all():
            over = np.repeat(~active, lengths)
            done.append((owner[~active], lengths[~active], symbols[over]))
            symbols, rank, merged = symbols[~over], rank[~over], merged[~over]
            owner, lengths, least = owner[active], lengths[active], least[active]
            if not len(owner):
                break
        at = np.flatnonzero(rank == np.repeat(least, lengths))
        run = np.ones(len(at), bool)  # of hits side by side, the first, third, ... merge
        run[1:] = np.diff(at) != 1
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        ends = np.cumsum(lengths)
        whose = np.searchsorted(ends, at, "right")
        lengths = lengths - np.bincount(whose, minlength=len(lengths))
        rank[at] = NONE
        symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
        at = at - np.arange(len(at))
        ends = np.cumsum(lengths)
        stale = np.concatenate([at[at + 1 < ends[whose]], (at - 1)[at > ends[whose] - lengths[whose]]])
    counts = np.zeros(len(texts), np.int64)
    for who, n, _ in done:
        counts[who] = n
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for who, n, ids in done:
        out[ragged(starts[who], n)] = ids
    return out, counts


def merged_padded(vocabulary: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length-bucketed matrices: (ids of all texts end to end, number of ids of each).

    Rows of a bucket have up to twice the symbols of the bucket before. Every round each row merges its
    leftmost lowest-rank pair and closes the gap; rows without one leave the matrix. A text of more than FOLD symbols is
    folded into several lines of a matrix, which still merges one pair a round.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts, parts = np.zeros(len(texts), np.int64), []
    width, below = 2, 0
    while below < lengths.max(initial=0):
        rows = np.flatnonzero((lengths > below) & (lengths <= width))
        step = max(1, min(CHUNK, (1 << 21) // width))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            ids, n = (_matrix if width <= FOLD else _folded)(vocabulary, [texts[i] for i in own], lengths[own], width)
            counts[own] = n
            parts.append((own, n, ids))
        below, width = width, width * 2
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for who, n, ids in parts:
        out[ragged(starts[who], n)] = ids
    return out, counts


def _folded(vocabulary: Vocabulary, texts: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As _matrix(), for long texts: each is folded into lines of FOLD cells, of which the least rank is kept beside them.

    A round looks at the least ranks of a text's lines, and at the cells of the line it merges in: not at the whole text.
    """
    n, cols = len(texts), np.arange(FOLD)
    lines = -(-lengths // FOLD)
    head = np.cumsum(lines) - lines
    whose = np.repeat(np.arange(n), lines)
    inside = np.arange(len(whose)) - head[whose]
    size = np.minimum(lengths[whose] - inside * FOLD, FOLD)
    after = np.where(inside < lines[whose] - 1, np.arange(len(whose)) + 1, -1)
    before = np.where(inside > 0, np.arange(len(whose)) - 1, -1)
    symbols = np.full((len(whose), FOLD), -1, np.int32)
    symbols[cols < size[:, None]] = vocabulary.byte[np.frombuffer(b"".join(texts), np.uint8)]
    rank, merged = np.full(symbols.shape, NONE, np.int32), np.full(symbols.shape, -1, np.int32)

    def look(line: np.ndarray, col: np.ndarray) -> None:
        """Ranks of the pairs that begin at these cells; the last cell of a line pairs with the first of the next one."""
        last = col == size[line] - 1
        right = np.where(last, symbols[after[line], 0], symbols[line, np.minimum(col + 1, FOLD - 1)])
        rank[line, col], merged[line, col] = NONE, -1
        on = ~(last & (after[line] < 0))
        line, col, right = line[on], col[on], right[on]
        rank[line, col], merged[line, col] = vocabulary.pairs.find(symbols[line, col], right)

    look(*np.nonzero(cols < size[:, None]))
    best = rank.min(1)
    while True:
        least = np.minimum.reduceat(best, head)
        flagged = np.flatnonzero((best == least[whose]) & (best != NONE))
        owner, first = np.unique(whose[flagged], return_index=True)
        if not len(owner):
            break
        line = flagged[first]
        col = rank[line].argmin(1)
        over = col == size[line] - 1  # the pair's second symbol is the first one of the next line
        symbols[line, col] = merged[line, col]
        gap, at = np.where(over, after[line], line), np.where(over, 0, col + 1)
        shift = np.minimum(cols + (cols >= at[:, None]), FOLD - 1)
        for table in (symbols, rank, merged):
            table[gap] = np.take_along_axis(table[gap], shift, 1)
        size[gap] -= 1
        rank[gap, size[gap]] = NONE
        empty = gap[size[gap] == 0]
        if len(empty):
            left, right = before[empty], after[empty]
            after[left] = right
            before[right[right >= 0]] = left[right >= 0]
        look(line, col)
        up = np.where(col > 0, line, before[line])
        has = up >= 0
        up, left = up[has], np.where(col > 0, col - 1, size[before[line]] - 1)[has]
        look(up, left)
        for touched in (line, gap, up):
            best[touched] = rank[touched].min(1)
    keep = cols < size[:, None]
    return symbols[keep], np.bincount(whose, size, n).astype(np.int64)


def _matrix(vocabulary: Vocabulary, texts: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, cols = len(texts), np.arange(width)
    inside = cols < lengths[:, None]
    symbols = np.full((n, width), -1, np.int32)
    symbols[inside] = vocabulary.byte[np.frombuffer(b"".join(texts), np.uint8)]
    rank, merged = np.full((n, width), NONE, np.int32), np.full((n, width), -1, np.int32)
    pair = cols < lengths[:, None] - 1
    rank[pair], merged[pair] = vocabulary.pairs.find(symbols[pair], symbols[:, 1:][pair[:, :-1]])
    out, left, row, size = symbols.copy(), lengths.copy(), np.arange(n), lengths.copy()
    while len(row):
        at = rank.argmin(1)
        each = np.arange(len(row))
        on = rank[each, at] != NONE
        if not on.all():
            out[row[~on]], left[row[~on]] = symbols[~on], size[~on]
            row, size, at, symbols, rank, merged = row[on], size[on], at[on], symbols[on], rank[on], merged[on]
            each = np.arange(len(row))
            if not len(row):
                break
        new = merged[each, at]
        shift = np.minimum(cols + (cols > at[:, None]), width - 1)
        symbols = np.take_along_axis(symbols, shift, 1)
        symbols[each, at] = new
        shift = np.minimum(cols + (cols >= at[:, None]), width - 1)
        rank, merged = np.take_along_axis(rank, shift, 1), np.take_along_axis(merged, shift, 1)
        size = size - 1
        symbols[each, size] = -1
        rank[each, size], rank[each, size - 1] = NONE, NONE
        for place, use in ((at - 1, at > 0), (at, at < size - 1)):
            r, c = each[use], place[use]
            rank[r, c], merged[r, c] = vocabulary.pairs.find(symbols[r, c], symbols[r, c + 1])
    keep = cols < left[:, None]
    return out[keep], left


class Store:
    """Pre-tokens met so far and their ids, `most` of them at most: when full it keeps those that came up again.

    Pre-tokens of more than `longest` characters are encoded each time and never stored, so its bytes have a bound too.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shed(self) -> None:
        keep = np.flatnonzero(self.uses >= 2)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-self.uses)[: self.most // 2])
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, self.lengths, self.uses = self.ids[ragged(self.starts[keep], self.lengths[keep])], self.lengths[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _add(self, new: list[str]) -> None:
        ids, lengths = self.encode(new)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """The place of every pre-token; starts, lengths and ids hold until the next call."""
        stored = len(self.index)
        if len(self.starts) > stored:  # what the last call had beside the store
            self.ids, self.starts, self.lengths = self.ids[: self.starts[stored]], self.starts[:stored], self.lengths[:stored]
        at = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = {tokens[k] for k in missing.tolist()}
            long = [x for x in new if len(x) > self.longest]
            new.difference_update(long)
            if len(self.index) + len(new) > self.most:
                self._shed()
                new = {x for x in set(tokens).difference(self.index) if len(x) <= self.longest}
                missing = np.arange(len(tokens))
            if new:
                base, new = len(self.index), list(new)
                self._add(new)
                self.index.update(zip(new, range(base, base + len(new)), strict=True))
                self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            places = dict(zip(long, range(len(self.index), len(self.index) + len(long)), strict=True))
            if long:
                self._add(long)
            get = self.index.get
            at[missing] = [places[tokens[k]] if (i := get(tokens[k])) is None else i for k in missing.tolist()]
        self.uses += np.bincount(at, minlength=len(self.uses))[: len(self.uses)]
        return at


def texts_to_ids(texts: list[str], split: Splitter, store: Store, special: tuple[str, int] | None, wanted: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """(ids of all texts end to end, or None if not wanted; number of ids of each).

    special: a string that a text may hold and the id it then has.
    """
    tokens: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    marks: list[int] = []
    for k, text in enumerate(texts):
        if special and special[0] in text:
            for n, part in enumerate(text.split(special[0])):
                if n:
                    marks.append(len(tokens))
                    tokens.append("")
                tokens += split(part)
        else:
            tokens += split(text)
        ends[k] = len(tokens)
    at = store.look_up(tokens)
    lengths = store.lengths[at]
    if marks:
        lengths[marks] = 1
    total = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.diff(total[np.concatenate([[0], ends])])
    if not wanted:
        return None, counts
    starts = store.starts[at]
    if marks:
        starts[marks] = 0
    ids = store.ids[ragged(starts, lengths)] if len(store.ids) else np.zeros(int(lengths.sum()), np.int32)
    if marks:
        ids[total[marks]] = special[1]
    return ids, counts

