"""Streams of revisions and votes.  Each function takes a batch or a streaming frame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(revisions: DataFrame, votes: DataFrame) -> DataFrame:
    """Both feeds as one; ``kind_rank`` orders a revision before a vote of the same time."""
    return revisions.withColumn("kind_rank", F.lit(0)).unionByName(votes.withColumn("kind_rank", F.lit(1)), allowMissingColumns=True)


def feed_order(feed: DataFrame, page: str, ts: str, tie: str) -> DataFrame:
    """Each event's place in its page's feed (batch, or within a micro-batch)."""
    return feed.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(ts, "kind_rank", tie)))


def time_buckets(rows: DataFrame, page: str, ts: str, hours: int = 24, late: str | None = None) -> DataFrame:
    """Events of each page by tumbling windows; a stream drops what comes later than ``late``."""
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(page, F.window(ts, f"{hours} hours").alias("w")).agg(F.count("*").alias("n")).select(page, F.col("w.start").alias("bucket"), "n")


def horizon(rows: DataFrame, page: str, order: list[str], value: str, n: int = 8) -> DataFrame:
    """The sum of ``value`` over the last ``n`` revisions of the page, this one included (batch)."""
    w = Window.partitionBy(page).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn("in_horizon", F.sum(value).over(w)).withColumn("n_horizon", F.count("*").over(w))


def increments_to(path: str, user: str, amount: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that files each user's increment under its batch id.

    A batch that is run again overwrites its own folder, so that an increment
    counts once; ``reputations`` adds them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.col(user).alias("user_id")).agg(F.sum(amount).alias("increment")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def reputations(increments: DataFrame, least: float = 0.0, most: float = 22026.0) -> DataFrame:
    """Current reputations from the increments filed so far, within bounds."""
    return increments.groupBy("user_id").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.sum("increment"))).alias("rep"))


def keys_to(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that files the keys that a batch has dealt with, votes for one, under its batch id; a batch that is run again says the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def all_of(*writes: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several ``foreachBatch`` functions on one batch, which is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for each in writes:
                each(kept, batch_id)
        finally:
            kept.unpersist()

    return write
