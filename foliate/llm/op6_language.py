"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import drop, fresh, in_arrow, met, parted, slices, text_of, utf8, written

#: Buckets of byte trigrams; languages scored at once.
BUCKETS, BLOCK = 1 << 14, 32
#: What a language needs for a model: declaring rows and their trigrams.
ROWS, TRIGRAMS = 8, 1024
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the byte trigrams of all texts end to end, number of each): letters and one mark for all else, none over two marks."""
    code = _LETTER[data].astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    keep[offsets[:-1][offsets[:-1] < len(code)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    hashed = (((code[:-2] * np.uint32(65599) + code[1:-1]) * np.uint32(65599) + code[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    n = np.maximum(np.diff(kept) - 2, 0)
    inside = np.ones(len(hashed), bool)
    for back in (1, 2):  # not over the end of a text
        at = kept[1:-1] - back
        inside[at[(at >= 0) & (at < len(hashed))]] = False
    letters = (code[:-2] > 0) | (code[1:-1] > 0) | (code[2:] > 0)
    which = np.searchsorted(kept[1:], np.flatnonzero(inside & ~letters), "right")
    return hashed[inside & letters].astype(np.int64), n - np.bincount(which, minlength=len(n))


def _counting(most: int = 256):
    """(declared, bucket, n) of a partition, given off whenever `most` codes are held; bucket -1 counts the rows of a code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for code, total in held.items():
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array([code] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(total[at])], ["declared", "bucket", "n"])
            held.clear()

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names = batch.column(0).dictionary_encode()
            own, names = names.indices.to_numpy(), names.dictionary.to_pylist()
            for a, b in slices(offsets, 1 << 21):
                codes, n = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                present, local = np.unique(own[a:b], return_inverse=True)
                wide = BUCKETS + 1
                total = np.bincount(codes + 1 + np.repeat(local.astype(np.int64) * wide, n), minlength=len(present) * wide).reshape(-1, wide)
                total[:, 0] = np.bincount(local, minlength=len(present))
                for k, row in zip(present.tolist(), total, strict=True):
                    if names[k] in held:
                        held[names[k]] += row
                    else:
                        held[names[k]] = row.copy()
                if len(held) > most:
                    yield from give()
        yield from give()

    return count


def _softmax(log: np.ndarray) -> np.ndarray:
    weights = np.exp(log - log.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _scoring(tables: Broadcast, index: dict[str, int], schema: list[str], temper: float):
    """Of each row: d, the place of its declaration; n, its trigrams; each, the mean log probability of a trigram in every
    language; votes, the posteriors over 0 of the text alone under equal priors as (k, v), with (-1, 1) to count the row.

    d is 0 for no declaration and one more than the number of languages for a code that has no model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = tables.value
        width = sum(t.shape[1] for t in blocks)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, end in slices(offsets, 1 << 21):
                for a in range(first, end, max(1, (1 << 22) // width)):
                    b = min(end, a + max(1, (1 << 22) // width))
                    codes, n = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    sums = np.zeros((len(n), width))
                    on = np.flatnonzero(n)
                    at = 0
                    for t in blocks if len(on) else ():
                        sums[on, at : at + t.shape[1]] = np.add.reduceat(t[codes], (np.cumsum(n) - n)[on], axis=0)
                        at += t.shape[1]
                    each = sums / np.maximum(n, 1)[:, None]
                    p = _softmax(each * n[:, None] * temper)
                    row, k = np.nonzero(p)
                    starts = np.searchsorted(row, np.arange(len(n)))
                    ks, vs = np.insert(k, starts, -1).astype(np.int32), np.insert(p[row, k], starts, 1.0)
                    ends = np.concatenate([starts + np.arange(len(n)), [len(ks)]])
                    votes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(ks), pa.array(vs)], ["k", "v"]))
                    d = [0 if not x else index.get(x, width) + 1 for x in batch.column("declared")[a:b].to_pylist()]
                    yield pa.record_batch([*(batch.column(c)[a:b] for c in schema), pa.array(d, pa.int32()), pa.array(n), _lists(each), votes], [*schema, "d", "n", "each", "votes"])

    return score


def _sums(votes: DataFrame, *by: str) -> DataFrame:
    return votes.groupBy(*by, "k").agg(F.sum("v").alias("v"))


def host_sums(votes: DataFrame) -> tuple[DataFrame, list]:
    """((host, of_rows, of_host, of_domain, of_suffix), sums of all rows) from votes(host, k, v).

    Levels are the host, the domain, the address suffix and all rows: each is a grouped sum of the level below. Sums are
    arrays of (k, v) with the rows under k = -1; languages that none of its rows has any weight for are not in them.
    """
    parts = F.split("host", r"\.")
    hosts = _sums(votes, "host").withColumns({"suffix": F.element_at(parts, -1), "domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")})
    hosts = written(hosts, "hosts")
    domains = _sums(hosts, "suffix", "domain")
    suffixes = _sums(domains, "suffix")
    whole = _sums(suffixes).collect()
    listed = lambda df, name, *by: df.groupBy(*by).agg(F.collect_list(F.struct("k", "v")).alias(name))
    domains = listed(domains, "of_domain", "suffix", "domain").join(listed(suffixes, "of_suffix", "suffix"), "suffix")
    own = hosts.groupBy("suffix", "domain", "host").agg(F.collect_list(F.struct("k", "v")).alias("of_host"), F.sum(F.when(F.col("k") < 0, F.col("v")).otherwise(0.0)).alias("of_rows"))
    return own.join(domains, ["suffix", "domain"]).drop("suffix", "domain"), whole


def _deciding(shared: Broadcast, schema: list[str], strength: float, margin: float, temper: float):
    """Posteriors from text, host and declaration; what identify() says of each row."""

    def dense(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sums) of an array of (k, v)."""
        out = np.zeros((len(lists), width + 1))
        flat = lists.flatten()
        out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), flat.field("k").to_numpy() + 1] = flat.field("v").to_numpy()
        return out[:, :1], out[:, 1:]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, said, whole, entropy = shared.value
        width, real = len(said[0]), bool(languages)
        for full in batches:
            step = max(1, (1 << 21) // width)
            for batch in (full.slice(k, step) for k in range(0, full.num_rows, step)):
                n, d = batch.column("n").to_numpy(), batch.column("d").to_numpy()
                each = batch.column("each").flatten().to_numpy().reshape(-1, width)
                text = each * n[:, None] * temper
                above = whole[None, :]
                for level in ("of_suffix", "of_domain"):
                    rows, sums = dense(batch.column(level), width)
                    above = (sums + strength * above) / (rows + strength)
                rows, sums = dense(batch.column("of_host"), width)
                prior = np.log((np.maximum(sums - _softmax(text), 0.0) + strength * above) / (rows - 1 + strength))
                q = _softmax(prior + text + said[d])
                row = np.arange(len(n))
                at, best = q.argmax(1), each.argmax(1)
                top = each[row, best]
                place = np.clip(d - 1, 0, width - 1)
                known, unknown = real & (d > 0) & (d <= width), (d > width) | (~np.bool_(real) & (d > 0))
                other = known & (n > 0) & (top - each[row, place] > margin) & (q[row, place] < 0.01)
                # a code without a model: no ratio to the declared language, so the text is held against what texts of its best language have
                fits = real & unknown & (entropy[best] + top > -margin) & (q[row, best] > 0.99) & (n * temper * margin > np.log(100))
                own = unknown & ~fits
                names = np.array([*languages, *[None] * (width - len(languages))], object)
                said_code = np.array(batch.column("declared").to_pylist(), object)
                lang = np.where(own, said_code, names[at])
                text_lang = np.where((n > 0) & ~own, names[best], None)
                kept = ~(other | fits | ((n == 0) & (d == 0)))
                yield pa.record_batch(
                    [*(batch.column(c) for c in schema), pa.array(lang.tolist(), pa.string()), pa.array(q.max(1), mask=own), pa.array(text_lang.tolist(), pa.string()), pa.array(kept)],
                    [*schema, "lang", "prob", "text_lang", "kept"],
                )

    return decide


def identify(df: DataFrame, text: Column, declared: Column, host: Column, keys: list[str], strength: float = 20.0, margin: float = 0.6, temper: float = 1 / 3) -> DataFrame:
    """(keys, lang, prob, text_lang, declared, host, kept) for every row of df.

    text, declared (a language code such as en or en-GB) and host (an address such as www.example.org) are
    expressions over df. Every language that at least ROWS rows with TRIGRAMS trigrams together declare has a trigram model,
    counted over all rows that declare it. The posterior of a row multiplies its tempered text
    likelihood, the prior of its host (smoothed by `strength` rows of its domain, that by its suffix, that by all rows) without
    the row itself (hosts with a 256th of all rows go to every task, rows of others are shuffled by their host), and how often texts of a language declare what this row does; a code without a model is a
    declaration of its own kind there. Tables that meet in the driver grow with the number of languages only: trigram buckets by
    languages, in blocks of BLOCK, and languages by languages.

    kept is false where the text itself is clearly of another language than the one declared: the mean log ratio of a trigram
    is over `margin` and the posterior of the declared language under a hundredth; and where there is
    neither a letter in the text nor a declaration. Short texts follow their other evidence and stay.

    Of a row that declares a code without a model, the text is clearly of another language where it fits the model
    of one as that language's own texts do (its mean log probability is less by at most `margin` than that of all text the model was counted over), the
    posterior of that language is over 0.99, and it is long enough for `margin` to give odds of a hundred. Otherwise the code
    stands: lang is the declared code, prob and text_lang are null and the row is kept.

    Null or empty texts, hosts and declarations are no evidence; where no language has a model, lang is the declared code. Keys
    may be null or repeated. An empty table gives no rows.
    """
    spark = df.sparkSession
    code = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), "^[A-Za-z]{2,3}", 0))
    rows = df.select(*keys, F.coalesce(text, F.lit("")).alias("text"), code.alias("declared"), F.lower(F.coalesce(host, F.lit(""))).alias("host"))
    counts = in_arrow(rows.select("declared", "text").where("declared <> ''"), _counting(), "declared string, bucket int, n long")
    counts = written(counts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")), "counts")
    named = counts.groupBy("declared").agg(F.sum(F.when(F.col("bucket") < 0, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).alias("trigrams"))
    named = named.where((F.col("rows") >= ROWS) & (F.col("trigrams") >= TRIGRAMS)).orderBy(F.desc("rows"), "declared").collect()
    languages = [r["declared"] for r in named]
    index = {c: k for k, c in enumerate(languages)}
    width = max(len(languages), 1)

    blocks, entropy = [], []
    for k in range(0, width, BLOCK):
        block = languages[k : k + BLOCK]
        table = np.full((BUCKETS, max(len(block), 1)), 0.5)
        if block:
            found = counts.where(F.col("declared").isin(block) & (F.col("bucket") >= 0)).toArrow()
            table[found["bucket"].to_numpy(), [index[c] - k for c in found["declared"].to_pylist()]] += found["n"].to_numpy()
        share = table / table.sum(0)
        own = table - 0.5 if block else table
        entropy.append(-(own * np.log(share)).sum(0) / own.sum(0))
        blocks.append(np.log(share).astype(np.float32))
    entropy = np.concatenate(entropy)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    slim = [*keys, "declared", "host"]
    kept_columns = ", ".join(f"`{c}` {kinds[c]}" for c in slim)
    drop(counts)
    texts = written(in_arrow(rows, _scoring(spark.sparkContext.broadcast(blocks), index, slim, temper), kept_columns + ", d int, n long, each array<double>, votes array<struct<k: int, v: double>>"), "texts")

    table_d = np.full((width + 2, width), 0.5)
    for r in _sums(texts.select("d", F.inline("votes")).where("k >= 0"), "d").collect():
        table_d[r.d, r.k] += r.v
    said = np.log(table_d / table_d.sum(0))

    hosts, top = host_sums(texts.select("host", F.inline("votes")))
    whole = np.zeros(width + 1)
    for r in top:
        whole[r.k + 1] = r.v
    shared = spark.sparkContext.broadcast((languages, said, (whole[1:] + strength / width) / (whole[0] + strength), entropy))
    both = met(texts.drop("votes"), written(hosts, "priors"), ["host"], "of_rows", int(whole[0]), 256).drop("of_rows")
    out = in_arrow(both, _deciding(shared, slim, strength, margin, temper), kept_columns + ", lang string, prob double, text_lang string, kept boolean")
    return out.select(*keys, "lang", "prob", "text_lang", F.nullif("declared", F.lit("")).alias("declared"), F.nullif("host", F.lit("")).alias("host"), "kept")


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, navigation, asides, headers, footers and tags."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|aside|header)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"(?s)<[^>]*>|&#?[A-Za-z0-9]{1,8};", " ")


def languages_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, prob, text_lang, declared, host, kept) of all documents and all pages together.

    A document's source stands for its host and its lang for what its markup declares; a page has them in its address and its html tag.
    """
    docs = documents.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), text_of("text").alias("text"), F.col("lang").alias("said"), F.col("source").alias("at"))
    web = pages.select(
        F.lit(None).cast("bigint").alias("doc_id"),
        "page_id",
        page_text(F.col("html")).alias("text"),
        F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1).alias("said"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1).alias("at"),
    )
    return identify(docs.union(web), F.col("text"), F.col("said"), F.col("at"), ["doc_id", "page_id"])


def in_known_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of df that identify() keeps, with all columns.

    Rows are told apart by two hashes of id, text, language and host, so of rows with one id each is judged by itself, and
    rows with a null id are judged as all others.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (id_col, text_col, lang_col, host_col)]
    k1, k2, g1, g2 = fresh(df, "key_a", "key_b", "gone_a", "gone_b")
    keyed = df.withColumns({k1: F.xxhash64(*parts), k2: F.xxhash64(F.lit(7), *parts)})
    found = identify(keyed, F.col(text_col), F.col(lang_col), F.col(host_col), [k1, k2])
    gone = written(found.where(~F.col("kept")).select(F.col(k1).alias(g1), F.col(k2).alias(g2)).distinct(), "gone")
    sure, rest = parted(keyed, k1, gone.select(g1))
    return sure.union(rest.join(gone, (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2)), "left_anti")).drop(k1, k2)
