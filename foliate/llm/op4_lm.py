"""Log-bilinear language model over two words of context, trained with noise-contrastive estimation; base scores from token counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import in_arrow, slices, text_of, utf8, written

#: Words whose counts every task holds, the most frequent ones of at most LONGEST bytes each: 16 MB at most. The first OWN of
#: them are the model's own: they are more the larger the corpus is, up to this bound.
HELD, OWN, LONGEST = 1 << 17, 1 << 15, 64
#: Other words are one of these by a hash of their last two bytes. END is a token as the contract has it.
TAILS = 512
END = b""
#: Groups of outputs; components of a vector; words of context.
GROUPS, DIMENSION, CONTEXT = 128, 7, 2
#: Rounds of training; training tokens of a shard; tokens that are mixed before they are cut into minibatches, and tokens of one.
ROUNDS, SHARD, RUN, BATCH = 8, 1 << 23, 1 << 18, 8192


def tokens(text: str) -> list[bytes]:
    """Lower-case (A-Z) words between white space; bytes.split() parts at exactly `[\\x20\\x09-\\x0D]+`."""
    return text.encode().lower().split()


def _counts(most: int = 400_000):
    """(token, count) of the training rows of a partition, given off whenever `most` distinct tokens are held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        give = lambda: pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for a, b in slices(utf8(batch.column("text"))[1], 1 << 22):
                for text in batch.column("text")[a:b].to_pylist():
                    counts.update(tokens(text))
                counts[END] += b - a
                if len(counts) > most:
                    yield give()
                    counts.clear()
        if counts:
            yield give()

    return count


class Lexicon:
    """What every task holds of the vocabulary: frequent words, the first of which are the model's own, and sums over the tails of all others.

    A symbol is an own word or a tail; symbols are numbered by how often training texts have them, and groups of symbols are
    ranges of these numbers with equal sums of square roots of their counts: frequent words are a group alone.
    """

    def __init__(self, words: list[tuple[bytes, int]], size: int, total: int, rows: list[tuple[int, int, int]]):
        self.total, self.size = total, size
        self.index = {w: k for k, (w, _) in enumerate(words)}
        self.n = np.array([n for _, n in words] + [0], np.int64)
        # of each tail: training tokens and distinct training words that aren't the model's own
        self.tail_n, self.tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for c, n, v in rows:
            self.tail_n[c], self.tail_v[c] = n, v
        own = min(len(words), OWN)
        if END in self.index:
            own = max(own, self.index[END] + 1)
        for w, n in words[:own]:
            if w != END:
                self.tail_n[suffix(w)] -= n
                self.tail_v[suffix(w)] -= 1
        mass = np.concatenate([self.n[:own], self.tail_n + self.tail_v, [0] if END not in self.index else []]) + 1.0
        rank = np.empty(len(mass), np.int32)
        order = np.argsort(-mass, kind="stable")
        rank[order] = np.arange(len(mass), dtype=np.int32)
        self.tail = rank[own : own + TAILS]
        self.symbol = np.concatenate([rank[:own], self.tail[np.array([suffix(w) for w, _ in words[own:]], np.int64)], [-1]]).astype(np.int32)
        self.inside = np.append(np.where(np.arange(len(words)) < own, 0.0, np.log10(self.n[:-1] + 1.0)), 0.0)
        self.end = int(rank[self.index[END]] if END in self.index else rank[-1])
        self.share = mass[order] / mass.sum()
        root = np.cumsum(np.sqrt(self.share))
        self.group = np.minimum((root / root[-1] * GROUPS - 1e-9).astype(np.int64), GROUPS - 1)
        self.group = np.unique(self.group, return_inverse=True)[1]
        self.first = np.append(np.searchsorted(self.group, np.arange(self.group[-1] + 1)), len(mass))
        self.group_share = np.add.reduceat(self.share, self.first[:-1])

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among the held words, len(held) if none; symbol) of each word."""
        missing = len(self.n) - 1
        at = np.fromiter(map(self.index.get, words, repeat(missing)), np.int64, len(words))
        symbol = self.symbol[at]
        rare = np.flatnonzero(at == missing)
        if len(rare):
            symbol[rare] = self.tail[[suffix(words[k]) for k in rare.tolist()]]
        return at, symbol

    def contexts(self, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """tokens x CONTEXT: the symbols before each, nearest first; END stands before a text."""
        out = np.full((len(symbol), CONTEXT), self.end, np.int32)
        place = np.arange(len(symbol)) - np.repeat(starts, np.diff(np.append(starts, len(symbol))))
        for k in range(CONTEXT):
            at = np.flatnonzero(place > k)
            out[at, k] = symbol[at - k - 1]
        return out


def suffix(word: bytes) -> int:
    """The tail of a word beyond the model's own."""
    return zlib.crc32(word[-2:]) % TAILS


class LogBilinear:
    """P(w | context) = P(group of w | context) P(w | its group, context), each a softmax of products with the context's vector.

    That vector is the sum of the vectors of the words before, each weighted by a vector of its place. Arrays: r, vectors of
    context words; c, of places; u and q, of groups and words as outputs, with a bias as their last component.
    """

    def __init__(self, lexicon: Lexicon, seed: int = 7, arrays: dict[str, np.ndarray] | None = None):
        self.lexicon = lexicon
        if arrays:  # goes on from these
            self.r, self.c, self.u, self.q = (np.ascontiguousarray(arrays[name]) for name in ("r", "c", "u", "q"))
            return
        rng = np.random.default_rng(seed)
        size, groups = len(lexicon.share), len(lexicon.group_share)
        self.r = rng.normal(0, 0.3, (size, DIMENSION)).astype(np.float32)
        self.c = np.ones((CONTEXT, DIMENSION), np.float32)
        self.u, self.q = np.zeros((groups, DIMENSION + 1), np.float32), np.zeros((size, DIMENSION + 1), np.float32)
        self.u[:, -1] = np.log(lexicon.group_share)
        self.q[:, -1] = np.log(lexicon.share / lexicon.group_share[lexicon.group])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"r": self.r, "c": self.c, "u": self.u, "q": self.q}

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        """The vectors of contexts, with a one at the end that biases meet."""
        h = np.ones((len(contexts), DIMENSION + 1), np.float32)
        h[:, :-1] = (np.take(self.r, contexts, 0) * self.c).sum(1)
        return h

    def log_probabilities(self, contexts: np.ndarray, symbol: np.ndarray, step: int = 65536) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of symbols after contexts, by batched products."""
        lexicon, out = self.lexicon, np.empty(len(symbol))
        for a in range(0, len(symbol), step):
            h, s = self.hidden(contexts[a : a + step]), symbol[a : a + step]
            group = lexicon.group[s]
            own = np.empty(len(s))
            for k in range(0, len(s), 1024):
                own[k : k + 1024] = _log_share(h[k : k + 1024], self.u, group[k : k + 1024])
            order = np.argsort(group.astype(np.int16), kind="stable")
            bounds = np.searchsorted(group[order], np.arange(len(lexicon.first)))
            for g in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(lexicon.first) > 1)).tolist():
                low, high = lexicon.first[g], lexicon.first[g + 1]
                wide = max(1, (1 << 18) // int(high - low))  # products stay in the processor's cache
                for k in range(bounds[g], bounds[g + 1], wide):
                    rows = order[k : min(k + wide, bounds[g + 1])]
                    own[rows] += _log_share(np.take(h, rows, 0), self.q[low:high], s[rows] - low)
            out[a : a + step] = own
        return out


#: Odds of so much either way have exponentials whose sums single precision holds.
_FLAT = 60.0


def _log_share(h: np.ndarray, outputs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of the products with all outputs, at one of them for each row."""
    odds = h @ outputs.T
    if np.einsum("nd,nd->n", h, h).max() * np.einsum("nd,nd->n", outputs, outputs).max() > _FLAT**2:  # products are at most those of the lengths
        odds -= odds.max(1, keepdims=True)
    own = odds[np.arange(len(h)), at]
    np.exp(odds, out=odds)
    return own - np.log(odds @ np.ones(odds.shape[1], np.float32))


class Trainer:
    """Noise-contrastive estimation on batches of (context, word): a logistic regression tells words from noise drawn by how often
    texts have it, of all groups and of the words of the own group; adaptive steps on the rows that a batch touches."""

    def __init__(self, model: LogBilinear, seed: int, noise: int = 24, inner: int = 2, rate: float = 0.15):
        self.model, self.noise, self.inner, self.rate = model, noise, inner, rate
        self.rng = np.random.default_rng(seed)
        lexicon = model.lexicon
        pool = 1 << 10
        sums = np.concatenate([[0.0], np.cumsum(lexicon.share)])
        low, wide = sums[lexicon.first[:-1]], lexicon.group_share
        drawn = np.searchsorted(sums, low[:, None] + self.rng.random((len(wide), pool)) * wide[:, None], "right") - 1
        self.pool = np.clip(drawn, lexicon.first[:-1, None], lexicon.first[1:, None] - 1).astype(np.int32)
        self.shift = np.log(inner * lexicon.share / lexicon.group_share[lexicon.group]).astype(np.float32)  # of each word as noise of its group
        self.squares = {name: np.full(len(x), 1e-3, np.float32) for name, x in model.arrays().items()}
        self.touched = {name: np.zeros(len(x), np.float32) for name, x in model.arrays().items()}

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # OWN and TAILS are fewer than 65,536: sorted by digits
        rows = rows[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        sums, rows = np.add.reduceat(np.take(gradient, order, 0), starts), rows[starts]
        squares = self.squares[name][rows] + np.einsum("nd,nd->n", sums, sums) / np.float32(sums.shape[1])
        self.squares[name][rows] = squares
        sums *= (self.rate / np.sqrt(squares)).astype(np.float32)[:, None]
        self.model.arrays()[name][rows] -= sums
        self.touched[name][rows] += np.diff(np.append(starts, len(order)))

    def batch(self, contexts: np.ndarray, symbol: np.ndarray) -> None:
        model, lexicon = self.model, self.model.lexicon
        n = len(symbol)
        before = np.take(model.r, contexts, 0)
        h = np.ones((n, DIMENSION + 1), np.float32)
        h[:, :-1] = (before * model.c).sum(1)
        group = lexicon.group[symbol]
        fake = self.pool_of_groups()
        shift = np.log(len(fake) * lexicon.group_share).astype(np.float32)
        own = np.take(model.u, group, 0)
        real = _sigmoid((h * own).sum(1) - shift[group]) - 1
        false = _sigmoid(h @ model.u[fake].T - shift[fake])
        dh = real[:, None] * own + false @ model.u[fake]
        rows, gradients = [group, fake], [real[:, None] * h, false.T @ h]
        at = np.flatnonzero(np.diff(lexicon.first)[group] > 1)
        if len(at):
            s, hs = symbol[at], h[at]
            words = np.column_stack([s, self.pool[group[at][:, None], self.rng.integers(0, self.pool.shape[1], (len(at), self.inner))]])
            q = np.take(model.q, words, 0)
            p = _sigmoid(np.einsum("nkd,nd->nk", q, hs) - np.take(self.shift, words))
            p[:, 0] -= 1
            dh[at] += np.einsum("nk,nkd->nd", p, q)
            self._step("q", words.ravel(), (p[:, :, None] * hs[:, None, :]).reshape(-1, DIMENSION + 1))
        self._step("u", np.concatenate(rows), np.concatenate(gradients))
        dh = dh[:, None, :-1]
        self._step("c", np.arange(CONTEXT), np.einsum("ncd,nd->cd", before, dh[:, 0]))
        self._step("r", contexts.ravel(), (model.c * dh).reshape(-1, DIMENSION))

    def pool_of_groups(self) -> np.ndarray:
        """Groups drawn as noise for a batch."""
        return np.minimum(np.searchsorted(np.cumsum(self.model.lexicon.group_share), self.rng.random(self.noise)), len(self.model.lexicon.group_share) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 30)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """(first row, end, tokens of the rows end to end, where each text ends) of some megabytes at a time."""
    for a, b in slices(utf8(batch.column("text"))[1], 1 << 21):
        words: list[bytes] = []
        ends = []
        for text in batch.column("text")[a:b].to_pylist():
            words += tokens(text)
            words.append(END)
            ends.append(len(words))
        yield a, b, words, np.array(ends, np.int64)


#: Rows of an array that are sent together.
_ROWS = 512


_CODED = "id {kind}, held_out boolean, key long, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<struct<token: binary, n: bigint>>"


def _coded(lexicon: Broadcast):
    """Texts to what training and scores need of them: 16-bit numbers of the symbols, sums over the held words, and the other words with how
    often the text has them."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        missing = len(known.n) - 1
        log_n = np.log10(known.n + 1.0)
        inside = np.zeros(len(known.share))
        inside[known.tail] = np.log10(known.tail_n + known.tail_v + 1.0)
        for batch in batches:
            for a, b, words, ends in _texts(batch):
                at, symbol = known.symbols(words)
                starts = np.append(0, ends[:-1])
                total = lambda x: np.add.reduceat(x, starts)
                rare = np.flatnonzero(at == missing)
                whose = np.searchsorted(ends, rare, "right")
                lists, sums = [], [0]
                counts: list[int] = []
                for own_rare in np.split(rare, np.searchsorted(whose, np.arange(1, b - a))):
                    c = Counter(words[i] for i in own_rare.tolist())
                    lists += c.keys()
                    counts += c.values()
                    sums.append(len(lists))
                pairs = pa.StructArray.from_arrays([pa.array(lists, pa.binary()), pa.array(counts, pa.int64())], ["token", "n"])
                own = np.split(symbol.astype(np.uint16), ends[:-1])  # OWN and TAILS are fewer than 65,536
                yield pa.record_batch(
                    [batch.column("id")[a:b], batch.column("held_out")[a:b], batch.column("key")[a:b], pa.array(np.diff(ends, prepend=0)), pa.array(total((known.n[at] > 0).astype(np.int64))), pa.array(total(log_n[at])), pa.array(total(known.inside[at] - inside[symbol])), pa.array([x.tobytes() for x in own], pa.binary()), pa.ListArray.from_arrays(pa.array(sums, pa.int32()), pairs)],
                    ["id", "held_out", "key", "n_tokens", "n_known", "base", "inside", "symbols", "rare"],
                )

    return code


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, symbols, starts of texts) of about RUN tokens at a time, however rows are cut into batches."""
    held: list[np.ndarray] = []
    size, shard = 0, 0

    def run() -> tuple[int, np.ndarray, np.ndarray]:
        return shard, np.concatenate(held).astype(np.int32), np.append(0, np.cumsum([len(x) for x in held])[:-1])

    for batch in batches:
        for shard_, data in zip(batch.column("shard").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
            shard = shard_
            held.append(np.frombuffer(data, np.uint16))
            size += len(held[-1])
            if size >= RUN:
                yield run()
                held, size = [], 0
    if held:
        yield run()


def _training(lexicon: Broadcast, state: Broadcast, number: int):
    """Trains on the texts of a shard from the state that all shards start from: how far rows of arrays and their squares moved, weighted
    by their uses, as (shard, name, first, rows, moves)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(lexicon.value, arrays={name: x[:, :-1] for name, x in state.value.items()})
        trainer, shard = None, 0
        for shard, symbol, starts in _runs(batches):
            if trainer is None:
                trainer = Trainer(model, 1 + number + ROUNDS * shard)
                trainer.squares = {name: np.ascontiguousarray(x[:, -1]) for name, x in state.value.items()}
            contexts = lexicon.value.contexts(symbol, starts)
            order = trainer.rng.permutation(len(symbol))
            step = max(32, min(BATCH, len(order) // 64))  # a short run of texts gets smaller batches, so some dozens of them
            for k in range(0, len(order), step):
                trainer.batch(contexts[order[k : k + step]], symbol[order[k : k + step]])
        if trainer is None:
            return
        for name, values in model.arrays().items():
            uses = np.sqrt(trainer.touched[name])[:, None]
            now = np.column_stack([values, trainer.squares[name]])
            move = np.column_stack([uses * (now - state.value[name]), uses]).astype(np.float32)
            for k in range(0, len(move), _ROWS):
                own = move[k : k + _ROWS]
                on = np.flatnonzero(own[:, -1])
                if len(on):
                    rows = pa.array([on.astype(np.int32)], pa.list_(pa.int32()))
                    yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([k], pa.int32()), rows, pa.array([own[on].tobytes()], pa.binary())], ["shard", "name", "first", "rows", "moves"])

    return train


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the moves of a block over all shards, which come in order, one after the other: a task holds its own blocks only."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, first, rows, data in zip(*(batch.column(c).to_pylist() for c in ("name", "first", "rows", "moves")), strict=True):
            move = np.frombuffer(data, np.float32).astype(float).reshape(len(rows), -1)
            sums.setdefault((name, first), np.zeros((_ROWS, move.shape[1])))[rows] += move
    for (name, first), total in sums.items():
        mean = (total[:, :-1] / np.maximum(total[:, -1:], 1e-9)).astype(np.float32)
        yield pa.record_batch([pa.array([name]), pa.array([first], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["name", "first", "moves"])


def trained(coded: DataFrame, lexicon: Lexicon, shared: Broadcast) -> LogBilinear:
    """A model trained on coded(round, shard, key, symbols), in ROUNDS rounds of shards that all start from the state the last round ended with.

    The hash of a text names its round and its shard, and shards read their texts in the order of hashes; so the model doesn't depend on
    files, partitions or executors. Shards have about SHARD tokens; a round trains on its part of each. Rows of arrays, and the squares that
    steps are divided by, move by the mean of what shards moved them, weighted by the root of their uses.
    """
    spark, shards = coded.sparkSession, _shards(lexicon.total)
    model = LogBilinear(lexicon)
    squares = {name: np.full(len(x), 1e-3, np.float32) for name, x in model.arrays().items()}
    for number in range(ROUNDS):
        state = spark.sparkContext.broadcast({name: np.column_stack([x, squares[name]]) for name, x in model.arrays().items()})
        own = coded.where(F.col("round") == number).select("shard", "key", "symbols").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key")
        moves = in_arrow(own, _training(shared, state, number), "shard int, name string, first int, rows array<int>, moves binary")
        moves = moves.repartition("name", "first").sortWithinPartitions("name", "first", "shard")
        for r in in_arrow(moves, _averaged, "name string, first int, moves binary").collect():  # the model's own arrays: bounded by OWN
            values = model.arrays()[r.name][r.first : r.first + _ROWS]
            move = np.frombuffer(r.moves, np.float32).reshape(_ROWS, -1)[: len(values)]
            values += move[:, :-1]
            squares[r.name][r.first : r.first + _ROWS] += move[:, -1]
        state.unpersist()
    return model


def _shards(tokens: int) -> int:
    return max(1, -(-tokens // SHARD))


def _scores(model: Broadcast):
    """Adds to coded rows what the model gives for their symbols, many short texts at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value.lexicon
        for batch in batches:
            data, offsets = utf8(batch.column("symbols"))
            got = []
            for a, b in slices(offsets, 1 << 21):
                symbol = data[offsets[a] : offsets[b]].view(np.uint16).astype(np.int32)
                starts = (offsets[a:b] - offsets[a]) // 2
                got.append(np.add.reduceat(model.value.log_probabilities(known.contexts(symbol, starts), symbol) / np.log(10), starts))
            rest = [c for c in batch.schema.names if c not in ("symbols", "inside")]
            total = np.concatenate(got) + batch.column("inside").to_numpy()
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(total)], [*rest, "model"])

    return score


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, at most HELD: all those in steps of counts (a 64th of a power of two) that fit, so no task sends a list of its own."""
    step = F.floor(64 * F.log2("n")).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # at most 64 * 63 of them
    least, held = 64 * 64, 0
    for r in steps:
        held += r["count"]
        if held > HELD:
            break
        least = r["step"]
    words = [(bytes(r.token), r.n) for r in counts.where(step >= least).collect()]
    return sorted(words, key=lambda x: (-x[1], x[0]))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of df.

    Rows with crc32(id as text) mod `folds` = `fold` are held out; all others train, whole texts of them. Tokens are
    the words of the text, A-Z in lower case, and one end. base_score: log10 of add-one unigram probabilities.
    score: log10 probability by a log-bilinear model of two words of context over the OWN most frequent words and tails of other words; a word of a
    tail has (c + 1) / (N + V + 1) of the tail's probability, where one share is for words never seen.

    Counts are grouped over all tokens; every task holds only the most frequent words, to a fixed bound, and other
    words of a document meet their counts in a join. The model is trained once on every token of all training rows, in rounds whose shards
    are averaged (see trained()); it has as many parameters as its vocabulary. The same rows give the same scores, in whatever
    files and partitions they are. Whole texts are read, some megabytes at a time; columns beyond id and text aren't.

    Null and empty texts are one end token. Rows with null ids train and are not held out. Repeated rows count as often as they
    are there. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    out_ = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("id"), out_.alias("held_out"), F.xxhash64(text).alias("key"), text.alias("text"))
    counts = written(in_arrow(rows.where("NOT held_out").select("text"), _counts(), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = _frequent(counts.where(F.length("token") <= LONGEST))
    ending = F.pmod(F.crc32(F.expr("substr(token, greatest(length(token) - 1, 1), 2)")), F.lit(TAILS))
    tails = [tuple(r) for r in counts.where(F.length("token") > 0).groupBy(ending.alias("c")).agg(F.sum("n"), F.count("*")).collect()]
    lexicon = Lexicon(frequent, size, total, [(int(c), n, v) for c, n, v in tails])
    shared = spark.sparkContext.broadcast(lexicon)
    place = {"round": F.pmod("key", F.lit(ROUNDS)).cast("int"), "shard": F.pmod(F.shiftright("key", 20), F.lit(_shards(total))).cast("int")}
    coded = in_arrow(rows, _coded(shared), _CODED.format(kind=kind)).withColumns(place).withColumn("uid", F.monotonically_increasing_id())
    coded = written(coded, "coded", ["round"])
    model = spark.sparkContext.broadcast(trained(coded.where("NOT held_out"), lexicon, shared))

    columns = ["uid", "id", "held_out", "n_tokens", "n_known", "base"]
    parts = in_arrow(coded.select(*columns, "inside", "symbols"), _scores(model), f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double")
    rare = coded.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    met = rare.join(counts, "token").groupBy("uid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    out = parts.join(met, "uid", "left").withColumns({"known": F.coalesce("known", F.lit(0)), "logs": F.coalesce("logs", F.lit(0.0))})
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * float(np.log10(total + size + 1))).alias("base_score"),
        (F.col("model") + F.col("logs")).alias("score"),
    )
