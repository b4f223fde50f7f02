"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, in_arrow, slices, text_of, utf8, written

# Words of the lexicon voters.
NOUNS = frozenset("idiot idiots moron morons loser losers scum clown clowns imbecile imbeciles cretin cretins trash vermin creep creeps scumbag scumbags dimwit halfwit lowlife pig pigs parasite parasites".split())
ADJECTIVES = frozenset("stupid pathetic disgusting worthless dumb ugly useless idiotic moronic filthy vile braindead brainless spineless repulsive".split())
PROFANITY = frozenset("damn bastard bastards crap bullshit ass asshole arse bitch shit fuck fucking fucker piss dick".split())
ATTACK = re.compile(r"\byou(?:'re| are|r)?\s+(?:\w+\s+){0,2}(?:idiot|moron|loser|scum|clown|trash|stupid|pathetic|disgusting|worthless|dumb|ugly|useless)")
THREAT = re.compile(r"\b(?:shut up|go to hell|drop dead|kill yourself|get lost|i will (?:hurt|kill|find) you)\b")
WORD = re.compile(r"[^\W\d_]+")
#: Fixed voters; each family of the lexicon that labelled texts give, by its first three letters, is one more.
BUILT_IN = 6
PREFIXES = range(3, 8)
#: Sums of a round that are one row.
_SUMS = 1024
#: The least accuracy of labels that the label model considers.
TRUST = 0.98


def features(words: set[str]) -> set[str]:
    """The words, closed by $, and their first 3 to 7 letters."""
    return {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents with label 1, with label 0) of a partition's labelled texts."""
    for batch in batches:
        counts = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(features(set(WORD.findall(text.lower()))))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0]))], ["feature", "pos", "neg"])


def lexicon(train: DataFrame, least_z: float = 6.0, least_rows: int = 4, precision: float = 0.7) -> list[str]:
    """Features that labelled texts hold oftener with label 1, strongest first, by a two-proportion z score of at least least_z.

    train(text, label). Equal texts count once. A feature counts that least_rows texts of label 1 hold, and of whose texts the share `precision` has label 1. Of a chain of prefixes with equal counts the longest is
    taken. All that pass are taken; they are bounded by the texts of train.
    """
    train = train.select("text", "label").distinct()
    pos, neg = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).first()
    if not pos or not neg:
        return []
    counts = in_arrow(train.select("text", "label"), _counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg") + 1.0) / (pos + neg + 2.0)
    z = (F.col("pos") / float(pos) - F.col("neg") / float(neg)) / F.sqrt(share * (1 - share) * (1.0 / pos + 1.0 / neg))
    best = counts.where((F.col("pos") >= least_rows) & (F.col("pos") >= F.col("neg") * precision / (1 - precision))).withColumn("z", z).where(F.col("z") >= least_z).collect()
    out: list[str] = []
    seen: dict[tuple, str] = {}
    for r in sorted(best, key=lambda r: (-r.z, -len(r.feature), r.feature)):
        chain = (r.pos, r.neg, r.feature[:3])
        if not seen.get(chain, "").startswith(r.feature):
            seen.setdefault(chain, r.feature)
            out.append(r.feature)
    return out


def families(chosen: list[str]) -> np.ndarray:
    """The voter of every feature: one for all features with the same first three letters."""
    place: dict[str, int] = {}
    return np.array([place.setdefault(f.rstrip("$")[:3], BUILT_IN + len(place)) for f in chosen], np.int64)


def _voting(chosen: list[str]):
    place = {f: k for k, f in enumerate(chosen)}
    heads = {f.rstrip("$")[:3] for f in chosen}
    voter = families(chosen).tolist()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(utf8(batch.column(1))[1], 1 << 22):
                votes, held = [], []
                for text in batch.column(1)[a:b].to_pylist():
                    low = text.lower()
                    words = set(WORD.findall(low))
                    near = {w for w in words if w[:3] in heads}
                    own = sorted(place[f] for f in features(near) if f in place)
                    fixed = (
                        not words.isdisjoint(NOUNS), not words.isdisjoint(ADJECTIVES), not words.isdisjoint(PROFANITY),
                        not words.isdisjoint(("you", "your", "youre")) and ATTACK.search(low), THREAT.search(low),
                        len(text) >= 20 and sum(map(str.isupper, text)) > 0.5 * sum(map(str.isalpha, text)) > 5,
                    )
                    votes.append([k for k, on in enumerate(fixed) if on] + sorted({voter[k] for k in own}))
                    held.append(own)
                carried = [batch.column(k)[a:b] for k in range(2, batch.num_columns)]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(votes, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32())), *carried], ["id", "votes", "features", *batch.schema.names[2:]])

    return vote


class LabelModel:
    """P(votes, label | class): voters with a tree of dependencies, and the label as one more voter of unknown accuracy."""

    def __init__(self, voters: int):
        self.parent = np.full(voters, -1)
        self.given = np.tile(np.array([[0.02], [0.3]])[:, :, None], (1, voters, 2))  # class x voter x vote of its parent
        self.prior = np.array([0.95, 0.05])
        self.told = np.array([[0.9, 0.1], [0.1, 0.9]])  # class x label

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes, label) of rows x (label 0, label 1, no label), from rows x voters of 0 and 1."""
        up = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(np.float32)
        odds = np.full(len(votes), np.log(self.prior[1] / self.prior[0]))
        for c, sign in ((0, -1.0), (1, 1.0)):
            on, off = np.log(self.given[c]), np.log1p(-self.given[c])
            odds += sign * (off[:, 0].sum() + votes @ (on - off)[:, 0] + up @ (off[:, 1] - off[:, 0]) + (up * votes) @ ((on - off)[:, 1] - (on - off)[:, 0]))
        told = np.log(np.column_stack([self.told, np.ones(2)]))
        return 1 / (1 + np.exp(-np.clip(odds[:, None] + (told[1] - told[0])[None, :], -30, 30)))

    def sums(self, votes: np.ndarray, counts: np.ndarray, known: bool, pairs: bool) -> np.ndarray:
        """What a round needs of rows x voters that stand for counts(label 0, label 1, no label): expected counts, by class.

        known: rows without a label count nothing, as at the start, when the labels alone say what votes are worth."""
        q = self.posterior(votes)
        if known:
            q[:, :2] = [0.1, 0.9]
            counts = counts * [1.0, 1.0, 0.0]
        up = np.where(self.parent >= 0, votes[:, self.parent], 0)
        out = []
        for of in (1 - q, q):
            weight = (counts * of).sum(1)
            out += [[weight.sum()], (counts * of)[:, :2].sum(0), weight @ votes, weight @ (votes * up)]
            if pairs:
                out.append((votes.T @ (votes * weight[:, None].astype(np.float32))).ravel())
        return np.concatenate(out)

    def update(self, sums: np.ndarray, pairs: bool) -> None:
        """The most likely parameters given the sums of all rows, a little smoothed; with pairs also a new tree."""
        m = len(self.parent)
        own = sums.reshape(2, -1)
        total, labels, one, up = own[:, 0], own[:, 1:3], own[:, 3 : 3 + m], own[:, 3 + m : 3 + 2 * m]
        if pairs:
            both = own[:, 3 + 2 * m :].reshape(2, m, m)
            self.parent = _tree(total, one, both)
            up = np.where(self.parent >= 0, both[:, np.arange(m), self.parent], 0.0)
        self.prior = (total + 1) / (total.sum() + 2)
        told = (labels + 0.5) / (labels.sum(1, keepdims=True) + 1)
        own = np.maximum(told.diagonal(), TRUST)
        self.told = np.array([[own[0], 1 - own[0]], [1 - own[1], own[1]]])
        share = (one + 0.5) / (total + 1)[:, None]
        has = np.where(self.parent >= 0, one[:, self.parent], 0.0)
        for u, (n, of) in enumerate(((one - up, total[:, None] - has), (up, has))):
            self.given[:, :, u] = np.clip((n + 2 * share) / (of + 2), 1e-6, 1 - 1e-6)


def _tree(total: np.ndarray, one: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree of the greatest mutual information given the class, -1 where it would tell nothing."""
    m = one.shape[1]
    gain = np.zeros((m, m))
    for c in (0, 1):
        n = max(total[c], 1e-9)
        x, y, xy = one[c][:, None] / n, one[c][None, :] / n, both[c] / n
        for joint, base in ((xy, x * y), (x - xy, x * (1 - y)), (y - xy, (1 - x) * y), (1 - x - y + xy, (1 - x) * (1 - y))):
            joint, base = np.clip(joint, 1e-12, 1), np.clip(base, 1e-12, 1)
            gain += total[c] / max(total.sum(), 1e-9) * joint * np.log(joint / base)
    parent, best, near = np.full(m, -1), gain[0].copy(), np.zeros(m, np.int64)
    out = np.ones(m, bool)
    out[0] = False
    while out.any():
        j = int(np.where(out, best, -np.inf).argmax())
        if best[j] > 1e-6:
            parent[j] = near[j]
        out[j] = False
        closer = gain[j] > best
        near[closer], best[closer] = j, gain[j][closer]
    return parent


def _dense(lists: pa.Array, voters: int) -> np.ndarray:
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), voters), np.float32)
    out[np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()] = 1
    return out


def label_model(patterns: DataFrame, voters: int, rounds: int = 8, unlabelled: float = 0.1) -> LabelModel:
    """Fits a LabelModel by EM to patterns(votes array<int>, n0, n1, n): rows with these votes, by label 0, label 1 and none.

    A row without a label weighs `unlabelled` where some rows have one, so that what the voters have in common beside toxicity, such as
    topics, doesn't outweigh the labels.

    A round is one pass over the patterns, which sends back sums: their number is that of the voters, and in the round that finds the
    tree that of pairs of voters; a task gives them as arrays of _SUMS, a row each. The tree is found in the third round."""
    model = LabelModel(voters)
    labelled = patterns.agg(F.coalesce(F.sum(F.col("n0") + F.col("n1")), F.lit(0))).first()[0]
    for step in range(rounds):
        known, pairs = step == 0 and labelled > 0, step == 2

        def partial(batches: Iterator[pa.RecordBatch], now: LabelModel = model, known: bool = known, pairs: bool = pairs) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    counts = np.column_stack([part.column(c).to_numpy() for c in ("n0", "n1", "n")]) * [1.0, 1.0, unlabelled if labelled else 1.0]
                    own = now.sums(_dense(part.column("votes"), voters), counts, known, pairs)
                    total = own if total is None else total + own
            if total is not None:
                parts = [total[k : k + _SUMS].tobytes() for k in range(0, len(total), _SUMS)]
                yield pa.record_batch([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], ["k", "v"])

        sums = in_arrow(in_arrow(patterns, partial, "k long, v binary").repartition("k"), _added, "k long, v binary").orderBy("k").collect()
        if not sums:
            break
        model.update(np.concatenate([np.frombuffer(r.v) for r in sums]), pairs)
    return model


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, the sum of its arrays of doubles v) of a partition that has all rows of each of its k."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(data)
            sums[k] = sums[k] + own if k in sums else own
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["k", "v"])


def fitted(rows: list[np.ndarray], width: int, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft targets, the intercept last; rows: the places of the ones of each row.

    Newton steps, each solved by conjugate gradients, so nothing of the square of the width is held."""
    n = np.array([len(r) for r in rows], np.int64)
    own, flat = np.repeat(np.arange(len(rows)), n), np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    penalty = np.append(np.full(width, ridge), 1e-6)
    times = lambda w: np.bincount(own, w[flat], len(rows)) + w[-1]
    back = lambda r: np.append(np.bincount(flat, r[own], width), r.sum())
    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        r = -(back(weight * (p - target)) + penalty * w)
        curve = weight * (p * (1 - p) + 1e-6)
        step, d, size = np.zeros_like(w), r.copy(), r @ r
        first = size
        for _ in range(200):
            if size <= 1e-10 * first or size < 1e-18:
                break
            hd = back(curve * times(d)) + penalty * d
            alpha = size / (d @ hd)
            step += alpha * d
            r = r - alpha * hd
            size, before = r @ r, size
            d = r + size / before * d
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample: int = 20_000) -> DataFrame:
    """(id, held_out, score, predicted) for every row of df.

    labels(id, label 0 or 1) marks some rows; those whose crc32(id as text) mod `folds` is 0 are held out and
    never learnt from. Voters look at every whole text: fixed lexicons and patterns, and the families of a lexicon that
    labelled texts give (words and word beginnings over-represented with label 1). The votes of all rows,
    counted by pattern, fit the label model, in which a label is one more voter; its posteriors are the only targets of the classifier.

    sample bounds the labelled rows that give the lexicon and fit the classifier (those with the least hash of
    their id), and the rows without a label that fit it. Everything else covers all rows. One pass over the texts beside that of the sample.
    Very long texts are looked at whole.

    A null or empty text gets a score from an empty set of features. A row with a null id is scored, not held out,
    and has no label. Several labels of one id count as their greatest; null labels and labels other than 0 and
    1 as none. Without labels of both kinds the fixed voters alone are used. Repeated rows get equal scores. An empty table gives no rows.
    """
    out = _scored(df, labels, id_col, text_col, label_col, folds, sample, False)
    return out.select("id", _out_of(folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")).withColumnRenamed("id", id_col)


def _out_of(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(False))


def _scored(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, sample: int, carry: bool) -> DataFrame:
    """(id, score), with carry also the whole row: it goes along in the written table of votes, so that no join has to bring it back."""
    kind = df.schema[id_col].dataType.simpleString()
    carried = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    known = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~_out_of(folds))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *carried)
    along = "".join(f", row {f.dataType.simpleString()}" for f in rows.schema if f.name == "row")
    chosen_rows = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` pairs of numbers: small enough for every executor
    train = written(rows.select("id", "text").join(F.broadcast(chosen_rows), "id"), "train")
    chosen = lexicon(train)
    drop(train)
    voters = int(families(chosen).max(initial=BUILT_IN - 1)) + 1

    votes = written(in_arrow(rows, _voting(chosen), f"id {kind}, votes array<int>, features array<int>{along}"), "votes")
    marked = votes.select("id", "votes").join(known, "id", "left")
    count = lambda y: F.count(F.when(y, 1))
    patterns = written(marked.groupBy("votes").agg(count(F.col("label") == 0).alias("n0"), count(F.col("label") == 1).alias("n1"), count(F.col("label").isNull()).alias("n")), "patterns")
    model = label_model(patterns, voters)
    drop(patterns)

    mixed = [F.xxhash64("id"), "id", "votes", "features"]
    told = votes.join(F.broadcast(chosen_rows), "id").select("id", "votes", "features", "label").orderBy(*mixed).limit(sample)
    others = votes.join(known.select("id"), "id", "left_anti").select("id", "votes", "features", F.lit(2).alias("label")).orderBy(*mixed).limit(sample)
    fit = told.union(others).drop("id").toArrow().combine_chunks()  # 2 x sample rows
    x, target = [], np.zeros(0)
    if fit.num_rows:
        lists = [c.chunk(0) for c in (fit["votes"], fit["features"])]
        target = model.posterior(_dense(lists[0], voters))[np.arange(fit.num_rows), fit["label"].to_numpy()]
        x = [np.array([k for k in v if k < BUILT_IN] + [BUILT_IN + k for k in f], np.int64) for v, f in zip(*(c.to_pylist() for c in lists), strict=True)]
    weights = fitted(x, BUILT_IN + len(chosen), target, np.ones(len(x)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, weights[-1])
            for lists, first in ((batch.column(1), 0), (batch.column(2), BUILT_IN)):
                place = lists.flatten().to_numpy() + first
                own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                use = place < BUILT_IN if first == 0 else np.ones(len(place), bool)
                z += np.bincount(own[use], weights[place[use]], batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-z))), *batch.columns[3:]], ["id", "score", *batch.schema.names[3:]])

    return in_arrow(votes, score, f"id {kind}, score double{along}")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample: int = 20_000) -> DataFrame:
    """The rows of df whose text isn't predicted toxic, with all columns. Rows are not shuffled."""
    return _scored(df, labels, id_col, text_col, label_col, folds, sample, True).where("score < 0.5").select("row.*")
