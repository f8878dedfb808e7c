"""Features of revisions, as the quality models take them.

A revision has page, author (0: anonymous), name, ts, the judgements on it
(judge_weight, total_quality, min_quality), delta (the size of its change)
and hist, the number of its words by trust from 0 to 9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10


def _seconds(a: str, b: str) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b))


def _same_author(other: str) -> Column:
    """Both known or both anonymous, under one name."""
    return F.coalesce(((F.col("author") > 0) == (F.col(f"{other}_author") > 0)) & (F.col("name") == F.col(f"{other}_name")), F.lit(False))


def revision_features(revs: DataFrame, users: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """One row per revision with all features; ``users`` has author and reputation, ``now`` stands for a next revision that is missing.

    A page's first revision follows an empty one of the same time by nobody.
    """
    w = Window.partitionBy("page").orderBy(*order)
    none = F.array_repeat(F.lit(0), BINS).cast("array<double>")
    linked = revs.withColumn("hist", F.col("hist").cast("array<double>")).select(
        "*",
        F.coalesce(F.lag("author").over(w), F.lit(0)).alias("prev_author"),
        F.coalesce(F.lag("name").over(w), F.lit("")).alias("prev_name"),
        F.coalesce(F.lag("ts").over(w), F.col("ts")).alias("prev_ts"),
        F.coalesce(F.lag("hist").over(w), none).alias("prev_hist"),
        F.coalesce(F.lead("author").over(w), F.lit(0)).alias("next_author"),
        F.coalesce(F.lead("name").over(w), F.lit("")).alias("next_name"),
        F.coalesce(F.lead("ts").over(w), now).alias("next_ts"),
    )
    known = linked.join(users.select("author", "reputation"), "author", "left").withColumn("reputation", F.coalesce("reputation", F.lit(0.0)))
    length = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    sized = known.withColumn("length", length("hist")).withColumn("prev_length", length("prev_hist"))
    change = lambda i: F.col("hist")[i] - F.col("prev_hist")[i]
    dissent = F.col("judge_weight") - F.col("total_quality")
    return sized.select(
        "*",
        F.when(F.col("judge_weight") > 0, F.try_divide("total_quality", "judge_weight")).otherwise(0.0).alias("avg_quality"),
        F.ln(1 + _seconds("next_ts", "ts")).alias("logtime_next"),
        F.ln(1 + _seconds("ts", "prev_ts")).alias("logtime_prev"),
        (F.hour("ts") + F.minute("ts") / 60 + F.second("ts") / 3600).alias("hour_of_day"),
        F.ln(1 + F.col("prev_length")).alias("log_prev_length"),
        F.ln(1 + F.col("length")).alias("log_length"),
        F.when((F.col("length") == 0) | (F.col("prev_length") == 0), 1.0)
        .otherwise(F.try_divide(F.greatest("delta", F.abs(F.col("length") - F.col("prev_length"))), F.greatest("length", "prev_length")))
        .alias("risk"),
        *[F.col("hist")[i].alias(f"hist{i}") for i in range(BINS)],
        *[F.col("prev_hist")[i].alias(f"prev_hist{i}") for i in range(BINS)],
        *[(F.col("prev_hist")[i] / (1 + F.col("prev_length"))).alias(f"p_prev_hist{i}") for i in range(BINS)],
        *[(F.signum(change(i)) * F.ln(1 + F.abs(change(i)))).alias(f"l_delta_hist{i}") for i in range(BINS)],
        (F.col("author") == 0).alias("anon"),
        (F.col("prev_author") == 0).alias("prev_anon"),
        (F.col("next_author") == 0).alias("next_anon"),
        _same_author("prev").alias("prev_same_author"),
        _same_author("next").alias("next_same_author"),
        # judges who could have given the least quality, or -1, if all others gave 1
        F.when(F.col("min_quality") < 1, F.try_divide(dissent, 1 - F.col("min_quality"))).otherwise(0.0).alias("max_dissent"),
        (dissent / 2).alias("max_revert"),
    )
