"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, fresh, in_arrow, met, mixed, parted, ragged, slices, text_of, union, utf8, written
from foliate.llm.components import components, resolved
from foliate.session import ship

#: Rows and n-grams of one side of a verification tile: larger groups are cut into several. Tiles a side over which a
#: candidate group is verified by its band buckets.
TILE, GRAMS, WIDE = 1024, 1 << 21, 16
#: White space and punctuation beyond ASCII part words.
_BETWEEN = r"[\p{Z}\p{P}&&[^\x00-\x7f]]+"
_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands_for(threshold: float, recall: float, rows: int = 4) -> int:
    """The least number of bands of `rows` hashes with which a pair at the threshold meets with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct word n-grams of all texts end to end, sorted within each; number of each).

    Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z count as a-z. A
    text of fewer than n words has one n-gram, of all its words; a text without words has none.
    """
    with np.errstate(over="ignore"):
        word = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[offsets < len(data)]] = True
        before = np.concatenate([[False], word[:-1]])
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate([word[1:], [False]])
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        # a word's hash is a polynomial of its bytes: differences of running sums, brought to the power 0
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), _PRIME))])
        hashes = mixed((running[end] - running[start]) * _powers(len(data) + 1, _INVERSE)[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, offsets)
        words = np.diff(first)
        grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        at = ragged(first[:-1], grams)
        left = np.repeat(np.minimum(words, n), grams)
        out = left.astype(np.uint64)
        for k in range(n):
            out = np.where(left > k, mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, max(0, len(hashes) - 1))]), out) if len(hashes) else out
        whose = np.repeat(np.arange(len(words)), grams)
        order = np.lexsort((out, whose))
        out, whose = out[order], whose[order]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (whose[1:] != whose[:-1])
        return out[keep], np.bincount(whose[keep], minlength=len(words))


def band_hashes(sets: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A matrix of texts x bands: the hash of `rows` minima over each set under random linear maps; 0 for empty sets."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, np.uint32)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((len(counts), bands), np.uint64)
    if not len(full):
        return out
    low = (sets >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for band in range(bands):
            value = np.full(len(full), band + 1, np.uint64)
            for k in range(band * rows, band * rows + rows):
                h = low * factor[k]
                h ^= h >> np.uint32(15)
                value = mixed(value * np.uint64(31) + np.minimum.reduceat(h * np.uint32(0x2C1B3C6D) + shift[k], starts).astype(np.uint64))
            out[full, band] = value
    return out


def _signatures(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for a, b in slices(offsets, 1 << 19):
                sets, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keys = []
                with np.errstate(over="ignore"):
                    for salt in (1, 2):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets + np.uint64(salt * 0x632BE5AB)))])
                        ends = np.concatenate([[0], np.cumsum(counts)])
                        keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                hashes = band_hashes(sets, counts, bands, rows).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(hashes.ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.record_batch([*(batch.column(k)[a:b] for k in range(3)), pa.array(counts.astype(np.int64)), *map(pa.array, keys), lists], ["id", "t1", "t2", "n", "s1", "s2", "bands"])

    return sign


def _sets(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 19):
                sets, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                part = batch.slice(a, b - a).drop_columns(["text"])
                yield part.append_column("grams", pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64))))

    return make


def _overlaps(sets: list[np.ndarray], a: slice, b: slice) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, by products over blocks of n-grams that two sets share."""
    left, right = sets[a], sets[b]
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times[code] > 1
    code, row = code[use], row[use]
    renumbered = np.cumsum(times > 1) - 1
    code = renumbered[code]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for low in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(code, [low, low + width])
        x = np.zeros((len(left) + len(right), width), np.float32)
        x[row[i:j], code[i:j] - low] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _verified(cid: np.ndarray, size: np.ndarray, count: np.ndarray, bands: np.ndarray, grams: list[np.ndarray], cut: int | None, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: (rows with links, links, least class reached). cut: where a tile's second block begins.

    band: the place of the band of which the group is a bucket, so that pairs of an earlier common band are left to
    that one; -1 if the group is a whole candidate group."""
    m = len(cid)
    links, labels, step = np.zeros(m, np.int64), np.arange(m), 256
    for i in range(0, m if cut is None else cut, step):
        ie = min(i + step, m if cut is None else cut)
        for j in range(i if cut is None else cut, m, step):
            je = min(j + step, m)
            meet = np.zeros((ie - i, je - j), bool)
            for k in range(bands.shape[1] if band < 0 else band):
                meet |= bands[i:ie, k, None] == bands[None, j:je, k]
            if band >= 0:
                meet = ~meet
            if i == j:
                meet = np.triu(meet, 1)
            least, most = np.minimum(count[i:ie, None], count[None, j:je]), np.maximum(count[i:ie, None], count[None, j:je])
            x, y = np.nonzero(meet & (least >= threshold * most - 1e-9))
            if not len(x):
                continue
            if len(x) < 16:
                shared = np.array([len(np.intersect1d(grams[i + p], grams[j + q], assume_unique=True)) for p, q in zip(x, y, strict=True)])
            else:
                shared = _overlaps(grams, slice(i, ie), slice(j, je))[x, y]
            x, y = x + i, y + j
            on = shared >= threshold * (count[x] + count[y] - shared) - 1e-9
            x, y = x[on], y[on]
            links += np.bincount(x, size[y], m).astype(np.int64) + np.bincount(y, size[x], m).astype(np.int64)
            union(labels, x, y)
    on = links > 0
    return cid[on], links[on], cid[labels[on]]


def _verifier(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        part, side, cid = (table.column(x).to_numpy() for x in ("part", "side", "cid"))
        order = np.lexsort((cid, side, part))
        part, side, cid, size, same, band = (table.column(x).to_numpy()[order] for x in ("part", "side", "cid", "size", "same", "band"))
        bands = table.column("bands").combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(len(cid), -1)
        lists = table.column("grams").combine_chunks().take(pa.array(order))
        ends, flat = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
        grams = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        count = np.diff(ends).astype(np.int64)
        found = []
        start = 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
            own = slice(start, end)
            cut = None if same[start] else int(np.searchsorted(side[own], 1))
            if end - start > 1 and cut != 0:
                found.append(_verified(cid[own], size[own], count[own], bands[own], grams[own], cut, int(band[start]), threshold))
            start = end
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("cid", "links", "root"), columns, strict=True)))

    return verify


def _dealt(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, band, bin, part, side, same): the tiles that each candidate is verified in, from parts(node, component) and classes(cid, n, bands).

    A candidate group is cut into tiles of TILE rows and GRAMS n-grams a side, every two of which meet. A group of more than WIDE of
    them comes from chains of chance bands: of it only the rows of one band bucket meet.
    """
    groups = written(parts.withColumnRenamed("node", "cid").join(classes.select("cid", "n", "bands"), "cid"), "groups")
    total = groups.count()
    sized = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / GRAMS)).cast("int").alias("chunks"))
    heads = written(sized(groups, "component"), "heads")
    whole = met(groups.select("cid", "component"), heads.where(f"chunks <= {WIDE}"), ["component"], "members", total).select("cid", F.col("component").alias("key"), F.lit(-1).alias("band"), "chunks")
    giant = groups.join(heads.where(f"chunks > {WIDE}").select("component"), "component", "left_semi").select("cid", "n", F.posexplode("bands").alias("band", "key"))
    buckets = sized(giant, "key").where("members > 1")
    parted_ = met(giant, buckets, ["key"], "members", giant.count()).select("cid", "key", "band", "chunks")
    dealt = whole.union(parted_).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"side": (F.col("chunk") > F.col("other")).cast("int"), "same": (F.col("chunk") == F.col("other")).cast("int")})
    tiled = tiled.withColumn("part", F.xxhash64("key", "band", F.least("chunk", "other"), F.greatest("chunk", "other")))
    # small groups share tasks, by a number of bins that grows with the rows; a tile of a larger group is a task of its own
    bins = max(1, -(-total // TILE))
    return tiled.withColumn("bin", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("part"))).select("cid", "band", "bin", "part", "side", "same")


def _classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): rows(id, t1, t2, s1, s2, n) of df; ends(s1, s2, rep, n_links, component_id, size)."""
    text = text_of(text_col)
    folded = F.regexp_replace(F.lower(text), _BETWEEN, " ")
    keyed = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), folded.alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    bands = bands_for(threshold, recall, rows)
    signed = written(in_arrow(keyed, _signatures(n, bands, rows), f"id {kind}, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>"), "signed")
    grouped = signed.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("id").isNull(), "id", "t1", "t2")).alias("f"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    classes = written(grouped.select("s1", "s2", "size", "n", "bands", F.col("f.id").alias("rep"), F.col("f.t1").alias("t1"), F.col("f.t2").alias("t2"), F.monotonically_increasing_id().alias("cid")), "classes")

    # every band hash that two classes have links them to the least of its classes: as many links as rows, however large a bucket is
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.count("*").alias("members")).where("least < most").select("band", "least", "members")
    linked = met(banded, shared, ["band"], "members", classes.count() * bands).where("cid <> least").select("cid", "least").distinct()
    parts = written(components(linked), "parts")

    # the texts of candidates alone are shuffled, and their n-gram sets, once for each tile of their rows
    wanted = written(parts.withColumnRenamed("node", "cid").join(classes.select("cid", "size", "bands", "rep", "t1", "t2"), "cid").drop("component"), "wanted")
    hashed = keyed.withColumn("hash", F.xxhash64("t1", "id"))
    texts = parted(hashed, "hash", wanted.select(F.xxhash64("t1", "rep").alias("hash")))[1].drop("hash").dropDuplicates(["id", "t1", "t2"])
    texts = texts.join(wanted.withColumnRenamed("rep", "wanted_id").withColumnsRenamed({"t1": "w1", "t2": "w2"}), F.expr("t1 = w1 AND t2 = w2 AND id <=> wanted_id"))
    sets = written(in_arrow(texts.select("cid", "size", "bands", "text"), _sets(n), "cid long, size long, bands array<long>, grams array<long>"), "sets")
    tiles = written(_dealt(parts, classes), "tiles")
    ship(df.sparkSession)
    found = written(tiles.join(sets, "cid").groupBy("bin").applyInArrow(_verifier(threshold), "cid long, links long, root long"), "found")
    for done in (sets, parts, tiles, wanted):
        drop(done)
    ends = classes.select("s1", "s2", "cid", "rep").join(resolved(classes, found), "cid").drop("cid")
    return signed.select("id", "t1", "t2", "s1", "s2", "n"), written(ends, "ends")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99999, rows: int = 4) -> DataFrame:
    """(id, class_id, n_links, component_id, kept) for every row of df.

    Two rows are linked when the Jaccard similarity of their sets of word n-grams is at least the threshold.
    class_id: the smallest id with the same set; n_links: the other rows linked directly; component_id: the
    smallest id that links reach; kept: the row is its component's. Bands are as many as let a pair at the
    threshold meet with probability `recall`; every pair that meets is verified on its full sets.

    Rows of one set are a class before bands are made. A bucket of a band never gives pairs: its members join
    a candidate group by a star, and groups over 1,024 classes are verified in tiles that send back counts.

    Texts that are null, empty or without words link with nothing and are their own class. Rows with null ids link
    as others do and name a class only if it has no other row. Repeated rows are rows of one class; all rows with
    the id that stays are kept.
    """
    rows_, ends = _classes(df, id_col, text_col, n, threshold, recall, rows)
    total = ends.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    linked = met(rows_.where("n > 0"), ends, ["s1", "s2"], "size", total).select("id", F.col("rep").alias("class_id"), "n_links", "component_id")
    alone = rows_.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "class_id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of df that stay, with all columns: of each group of linked rows the one with the smallest id.

    Rows with the same id and text as the one that stays are all kept, so exact copies should go first.
    """
    how = {"n": 5, "threshold": 0.8, "recall": 0.99999, "rows": 4} | how
    rows, ends = _classes(df, id_col, text_col, **how)
    going = ends.where(~F.col("rep").eqNullSafe(F.col("component_id")) | (F.col("size") > 1))
    total = ends.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    gone = met(rows.where("n > 0"), going, ["s1", "s2"], "size", total).where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "t1", "t2").distinct()
    i, t1, t2, hash_ = fresh(df, "gone_id", "gone_t1", "gone_t2", "hash")
    gone = written(gone.toDF(i, t1, t2), "gone")
    text = text_of(text_col)
    sure, rest = parted(df.withColumn(hash_, F.xxhash64(F.xxhash64(text), F.col(id_col))), hash_, gone.select(F.xxhash64(t1, i).alias("hash")))
    match = F.xxhash64(text).eqNullSafe(F.col(t1)) & F.xxhash64(F.lit(7), text).eqNullSafe(F.col(t2)) & F.col(id_col).eqNullSafe(F.col(i))
    return sure.union(rest.join(gone, match, "left_anti")).drop(hash_)
