"""From raw documents to packed training sequences.

Each stage takes what the one before kept: quality rules reject documents,
one document of each near-duplicate group stays (that of the smallest id),
passages that an earlier document has are cut, personal data are masked,
and the rest is packed.  All stages but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut, documents, set_aside
from revlens.llm.ngram_join import jaccard_components
from revlens.llm.packing import pack
from revlens.llm.pii import mask_pii
from revlens.llm.quality_rules import keep_quality
from revlens.llm.recompression import without_repeats


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and go; equal rows are judged alike; extra columns stay; no rows give none."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest id stays, of equal rows one.

    Rows without an id are in no group and stay, empty texts too.  Rows that
    repeat an id with other texts are documents of their own.
    """
    safe, restored = set_aside(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    known = safe.where("doc_id is not null")
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        first = jaccard_components(known).where("doc_id = component_id").select("doc_id")
        kept = known.join(first, "doc_id", "left_semi")
    else:
        numbered = cut(known.withColumn("_row", F.monotonically_increasing_id()))
        groups = jaccard_components(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
        least = groups.join(numbered.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("least"))
        kept = numbered.join(least.select(F.col("least._row").alias("_row")), "_row", "left_semi").drop("_row")
    return restored(kept.unionByName(safe.where("doc_id is null")))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts become empty; rows without an id stay as they are; extra columns stay."""
    return _counted(without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no spans; equal rows are masked alike; extra columns stay."""
    return _counted(mask_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Empty texts are packed as the end token alone; extra columns are ignored."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", substrings),
    ("pii", personal_data),
    ("packing", packing),
]

#: No SQL expresses the divergence of the first stage, nor the differencing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
