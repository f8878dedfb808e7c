"""DuckDB SQL of the manifest, the resampling and the decontamination."""

from __future__ import annotations

import string

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def words(text: str) -> str:
    return f"regexp_extract_all({lowered(text)}, '{_WORDS}')"


def crc32(text: str) -> str:
    """Each byte enters, then eight shifts, with the polynomial wherever a one falls out."""
    digits = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, length({digits}) // 2), lambda i: [('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({steps}, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(lowered("text"))} ELSE {_leaf("text")} END AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
r(level, key, idx, n, digest) AS (
  SELECT 0, key, idx, n, leaf FROM l
  UNION ALL SELECT level + 1, key, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM r WHERE n > 1 GROUP BY level, key, idx // 8, n),
t AS (SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM r WHERE n = 1),
u(level, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM t
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
f(level, key, leaf_idx, idx, n, digest, proof) AS (
  SELECT 0, key, idx, idx, n, altered, '' FROM l
  UNION ALL
  SELECT f.level + 1, f.key, leaf_idx, f.idx // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN r.idx = f.idx THEN f.digest ELSE r.digest END, '' ORDER BY r.idx)),
    any_value(proof) || coalesce(string_agg(r.digest, '' ORDER BY r.idx) FILTER (r.idx <> f.idx), '')
  FROM f JOIN r ON r.level = f.level AND r.key = f.key AND r.idx // 8 = f.idx // 8 WHERE f.n > 1 GROUP BY f.level, f.key, leaf_idx, f.idx, f.n),
g(level, key, leaf_idx, idx, n, digest, proof) AS (
  SELECT 0, f.key, leaf_idx, t.idx, t.n, f.digest, proof FROM f JOIN t ON t.key = f.key WHERE f.n = 1
  UNION ALL
  SELECT g.level + 1, g.key, leaf_idx, g.idx // 8, (g.n + 7) // 8, sha256(string_agg(CASE WHEN u.idx = g.idx THEN g.digest ELSE u.digest END, '' ORDER BY u.idx)),
    any_value(proof) || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx <> g.idx), '')
  FROM g JOIN u ON u.level = g.level AND u.idx // 8 = g.idx // 8 WHERE g.n > 1 GROUP BY g.level, g.key, leaf_idx, g.idx, g.n)
SELECT l.doc_id, l.leaf, t.digest AS subroot, u.digest AS root, sha256(g.proof) AS proof_sha256, g.digest AS folded_root, g.digest = u.digest AS verified
FROM l JOIN t ON t.key = l.key JOIN g ON g.key = l.key AND g.leaf_idx = l.idx AND g.n = 1 JOIN u ON u.n = 1"""

RESAMPLING = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS w FROM d),
b AS (SELECT unnest({words("coalesce(text, '')")}) AS w FROM benchmark),
v AS MATERIALIZED (SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT w FROM o UNION SELECT w FROM b)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
z AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS ss, (SELECT count(*) FROM b)::DOUBLE AS tt),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
y AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN x USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM y WHERE n_features >= 20) * 10 // 100 AS draws FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draws THEN place END::BIGINT AS rank FROM k"""

DECONTAMINATION = f"""
WITH i AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda a: array_to_string(w[a:a + k - 1], ' '))) AS s FROM i),
d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
q AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda a: array_to_string(w[a:a + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
m AS (SELECT doc_id, k, pos, item_id FROM q JOIN p USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM (SELECT DISTINCT doc_id, pos, k FROM m)) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""
