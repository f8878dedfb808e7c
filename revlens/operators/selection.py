"""Choosing revisions of a page by the models' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import discount

RECENT, BASE = 100, 200.0


def _age(now: Column, ts: str) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)).cast("double")


def best_revisions(scored: DataFrame, now: Column, order: list[str], winners: int = 3, base: float = BASE, recent: int = RECENT) -> DataFrame:
    """The ``winners`` best of each page's last ``recent`` revisions, by quality discounted for age, then by low risk.

    ``scored`` has the features and quality.  ``forced`` is what the discount gains on the revision before.
    """
    latest = Window.partitionBy("page").orderBy(*[F.desc(c) for c in order])
    past = scored.withColumn("revisions_ago", F.row_number().over(latest)).where(F.col("revisions_ago") <= recent)
    here = discount(F.col("revisions_ago"), _age(now, "ts"), base)
    before = discount(F.col("revisions_ago") + 1, _age(now, "prev_ts"), base)
    valued = past.withColumn("discount", here).withColumn("forced", here - before).withColumn("days_ago", _age(now, "ts") / 86400).withColumn("value", F.col("quality") * F.col("discount"))
    best = Window.partitionBy("page").orderBy(F.desc("value"), F.asc("risk"), *[F.desc(c) for c in order])
    return valued.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= winners)


def recent_vandalism(scored: DataFrame, now: Column, order: list[str], recent: int = 40, days: int = 90, least: float = 0.3) -> DataFrame:
    """Of each page's last ``recent`` revisions those of at most ``days`` days whose quality is below ``least``."""
    latest = Window.partitionBy("page").orderBy(*[F.desc(c) for c in order])
    return scored.withColumn("_n", F.row_number().over(latest)).where((F.col("_n") <= recent) & (_age(now, "ts") <= days * 86400) & (F.col("quality") < least)).drop("_n")


def least_vandalised(scored: DataFrame, since: Column, order: list[str]) -> DataFrame:
    """Each page's revision of least vandalism since a time; of a page that has none since then, of all."""
    best = Window.partitionBy("page").orderBy(F.desc(F.col("ts") >= since), "vandalism", *[F.desc(c) for c in order])
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def best_feed(pages: DataFrame, scored: DataFrame, until: Column, order: list[str]) -> DataFrame:
    """For each wanted page (page, wanted revision or null) that revision, or else the last one until a time."""
    latest = Window.partitionBy("page").orderBy(*[F.desc(c) for c in order])
    last = scored.where(F.col("ts") <= until).withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("page", F.col("revision").alias("_last"))
    return pages.join(last, "page", "left").select("page", F.coalesce("wanted", "_last").alias("revision"))


def quality_report(scored: DataFrame) -> DataFrame:
    """The columns of a report on revisions, ready for ``write.csv``."""
    return scored.select("page", "revision", "name", "ts", F.round("quality", 4).alias("quality"), F.round("risk", 4).alias("risk"), F.col("delta"), F.col("length"))
