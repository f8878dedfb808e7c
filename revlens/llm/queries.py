"""The registered queries of the corpus operators, over the whole ``documents`` table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql_twins
from .common import documents
from .decontamination import decontaminated
from .importance_resampling import resample
from .interpolation_lm import score_texts
from .merkle_manifest import merkle_manifest
from .ngram_join import jaccard_components
from .packing import pack
from .pii import find_pii
from .quality_rules import judge_quality
from .recompression import dedup_substrings
from .sentencepiece_scan import decode, encode
from .spotsigs import fingerprint_documents
from .suffix_dedup import dedup_suffixes
from .toxicity_crf import score_toxicity


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids, and of the text that they decode to."""
    restored = decode(encode(documents(spark, sf_dir)))
    return restored.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op5_interpolation_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_QUERIES = (
    op1_spotsigs,
    op2_sentencepiece,
    op3_suffix_dedup,
    op4_ngram_join,
    op5_interpolation_lm,
    op6_substring_dedup,
    op7_pii,
    op8_quality_rules,
    op9_toxicity_crf,
    op10_packing,
    op11_merkle_manifest,
    op12_importance_resampling,
    op13_decontamination,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts as hexadecimal; repeated starts make runs of removed bytes, and what lies between the runs is kept.
_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS pos FROM d)),
r AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM r)),
g AS (SELECT doc_id, min(pos) AS lo, max(pos) + 100 AS hi FROM i GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM g),
k AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last_hi, string_agg(substr(h, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_hi, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

_SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
t AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM d WHERE len(w) >= 13),
r AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first_id FROM t) WHERE first_id < doc_id),
g AS (
  SELECT o.doc_id, o.pos, word, max(r.pos) OVER (PARTITION BY o.doc_id ORDER BY o.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM o LEFT JOIN r ON o.doc_id = r.doc_id AND o.pos = r.pos),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL can express in full: the other operators return fingerprints, ids or probabilities of models."""
    return {"op3_suffix_dedup": _SUFFIX_SQL, "op4_ngram_join": _JACCARD_SQL, "op6_substring_dedup": _SUBSTRING_SQL, "op11_merkle_manifest": sql_twins.MANIFEST, "op12_importance_resampling": sql_twins.RESAMPLING, "op13_decontamination": sql_twins.DECONTAMINATION}
