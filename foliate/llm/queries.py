"""The queries opN_<name>: each operator on its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import op1_quotes, op2_vectors, op3_tokens, op4_lm, op5_exact, op6_language, op7_ngrams, op8_packing, op9_toxicity, op10_codec, op11_trie, op12_divergence, op13_mix
from foliate.session import table

_VECTORS_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least.c, e.vec_id) AS component_id,
       e.vec_id = coalesce(least.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""

_EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""

_NGRAMS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\p{Z}\p{P}]+', ' ', 'g'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), d AS (
  SELECT doc_id, count(*) AS n, sum(hash(g)::HUGEINT) AS k FROM g GROUP BY doc_id
), class AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, k) AS c, count(*) OVER (PARTITION BY n, k) AS size FROM d
), gc AS (SELECT g.g, g.doc_id, class.n FROM g JOIN class USING (doc_id) WHERE class.doc_id = class.c
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM gc a JOIN gc b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM p WHERE 5 * s >= 4 * (na + nb - s)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
), n AS (SELECT a, sum(size) AS n FROM links JOIN class ON class.doc_id = links.b GROUP BY a)
SELECT doc_id, coalesce(class.c, doc_id) AS class_id, (coalesce(class.size - 1, 0) + coalesce(n.n, 0))::BIGINT AS n_links,
       coalesce(least.c, class.c, doc_id) AS component_id, doc_id = coalesce(least.c, class.c, doc_id) AS kept
FROM documents LEFT JOIN class USING (doc_id) LEFT JOIN n ON n.a = class.c LEFT JOIN least ON least.a = class.c
"""


_TRIE_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || '|' || coalesce(text, ''))) AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS d, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, digits, k, c) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM turns
  UNION ALL
  SELECT conv_id, digits, k + 1, xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(digits, k // 8 + 1, 1))::BIGINT) ELSE c END AS z FROM crc WHERE k < 8 * length(digits))
), opening AS (
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE k = 8 * length(digits)
), built AS (
  SELECT o.conv_id, t.pos, t.d, t.n FROM opening o JOIN turns t ON t.conv_id = o.base AND t.pos <= o.h
  UNION ALL
  SELECT o.conv_id, t.pos, t.d, t.n FROM opening o JOIN turns t ON t.conv_id = o.conv_id AND t.pos > o.h
), path AS (
  SELECT o.conv_id, coalesce(list(b.d ORDER BY b.pos) FILTER (b.d IS NOT NULL), []) AS p, coalesce(list(b.n ORDER BY b.pos) FILTER (b.d IS NOT NULL), []) AS s
  FROM opening o LEFT JOIN built b USING (conv_id) GROUP BY o.conv_id
), member AS (
  SELECT conv_id, d, md5(array_to_string(p[1:d], ' ')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(p[1:d - 1], ' ')) END AS over,
         CASE WHEN d > 0 THEN s[d] ELSE 0 END AS n, d = len(p) AS ends
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM path)
), node AS (
  SELECT d AS depth, node, any_value(over) AS over, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY d, node
), kids AS (SELECT depth - 1 AS depth, over AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, node)
), up AS (
  SELECT depth AS at_depth, node AS at_node, depth, node, over, saved, n_children FROM full_node
  UNION ALL
  SELECT up.at_depth - 1, up.over_at, up.depth, up.node, up.over, up.saved, up.n_children
  FROM (SELECT u.*, f.over AS over_at FROM up u JOIN full_node f ON f.depth = u.at_depth AND f.node = u.at_node) up WHERE up.at_depth > 0
), sums AS (SELECT at_depth AS depth, at_node AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_node f JOIN sums s USING (depth, node) LEFT JOIN full_node p ON p.depth = f.depth - 1 AND p.node = f.over
"""

_DIVERGENCE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), word AS (SELECT id, lang, source, unnest(ws) AS term FROM doc
), kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), lang AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM doc
), c AS (SELECT lang, source, term, count(*) AS c FROM word GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.n AS lang_c FROM grp g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), total AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL
), p AS (
  SELECT d.lang, d.source, d.term, d.c, 1 + 1000000000::HUGEINT * (d.c + 2) // (t.n + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (d.lang_c + 2) // (l.n + 2 * l.v) AS q
  FROM dense d JOIN total t USING (lang, source) JOIN lang l USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda f: lambda spark, folder: f(table(spark, folder, "documents"))
    return {
        "op1_quotes": lambda spark, folder: op1_quotes.linked(table(spark, folder, "conversations")),
        "op2_vectors": lambda spark, folder: op2_vectors.near_vectors(table(spark, folder, "embeddings")),
        "op3_tokens": documents(op3_tokens.token_counts),
        "op4_lm": documents(op4_lm.scored),
        "op5_exact": documents(op5_exact.exact_groups),
        "op6_language": lambda spark, folder: op6_language.languages_of(table(spark, folder, "documents"), table(spark, folder, "pages")),
        "op7_ngrams": documents(op7_ngrams.similar),
        "op8_packing": documents(op8_packing.packed),
        "op9_toxicity": lambda spark, folder: op9_toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")),
        "op10_codec": documents(op10_codec.codec_digests),
        "op11_trie": lambda spark, folder: op11_trie.nodes(table(spark, folder, "conversations")),
        "op12_divergence": documents(op12_divergence.divergences),
        "op13_mix": documents(op13_mix.mix),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_vectors": _VECTORS_SQL, "op5_exact": _EXACT_SQL, "op7_ngrams": _NGRAMS_SQL, "op11_trie": _TRIE_SQL, "op12_divergence": _DIVERGENCE_SQL}
