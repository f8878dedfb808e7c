"""Texts of revisions in folders by page, and dumps without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pages of one folder share these leading digits of their number.
PAGES_OF_A_FOLDER = 1000


def write_revision_files(revs: DataFrame, path: str) -> None:
    """(page_id, rev_id, text) as Parquet in folders of a thousand pages, so that a page's texts are found without a scan."""
    bucket = F.expr(f"page_id div {PAGES_OF_A_FOLDER}")
    rows = revs.select("page_id", "rev_id", "text", bucket.alias("bucket"))
    rows.repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(8))).sortWithinPartitions("page_id", "rev_id").write.partitionBy("bucket").parquet(path)


def read_revisions(spark: SparkSession, path: str, pages: list[int]) -> DataFrame:
    """The texts of some pages; only their folders are read."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("bucket").isin([p // PAGES_OF_A_FOLDER for p in pages]) & F.col("page_id").isin(pages)).select("page_id", "rev_id", "text")


def without_texts(revs: DataFrame) -> DataFrame:
    """The rows of a dump whose texts are kept in files."""
    return revs.withColumn("text", F.lit(""))


def last_coloured(revs: DataFrame, order: list[str], n: int) -> DataFrame:
    """Of each page the last ``n`` revisions, for a dump of coloured texts (``page_id``, ``text`` and the rest)."""
    latest = Window.partitionBy("page_id").orderBy(*[F.desc(c) for c in order])
    return revs.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")
