"""Revision histories: neighbours, collapsing, pruning and cursors.

A history has one row per revision; ``order`` are the columns that order it
within its page, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(page: str, order: list[str]):
    return Window.partitionBy(page).orderBy(*order)


def collapse_same_author(revs: DataFrame, page: str, author: str, order: list[str], address: str | None = None) -> DataFrame:
    """Of each run of one author's revisions the last.

    Revisions without an author are one author's; with ``address`` anonymous
    authors (0 or null) are told apart by it.
    """
    who = F.struct(F.col(author).alias("a"), (F.when(F.coalesce(F.col(author), F.lit(0)) == 0, F.col(address)) if address else F.lit(None).cast("string")).alias("b"))
    w = _by(page, order)
    told = revs.withColumn("_who", who).withColumn("_next", F.lead("_who").over(w))
    return told.where(F.col("_next").isNull() | ~F.col("_next").eqNullSafe(F.col("_who"))).drop("_who", "_next")


def last_revisions(revs: DataFrame, page: str, order: list[str], n: int) -> DataFrame:
    latest = Window.partitionBy(page).orderBy(*[F.desc(c) for c in order])
    return revs.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def with_neighbours(revs: DataFrame, page: str, order: list[str], columns: list[str]) -> DataFrame:
    """``prev_x`` and ``next_x`` of each column x."""
    w = _by(page, order)
    return revs.select("*", *[f(c).over(w).alias(f"{p}_{c}") for c in columns for p, f in (("prev", F.lag), ("next", F.lead))])


def cursor(revs: DataFrame, at: tuple[Column, Column], order: tuple[str, str], n: int, forward: bool = True) -> DataFrame:
    """The ``n`` revisions after (or before) a place, by row-value comparison."""
    a, b = map(F.col, order)
    if forward:
        return revs.where((a > at[0]) | ((a == at[0]) & (b > at[1]))).orderBy(a, b).limit(n)
    return revs.where((a < at[0]) | ((a == at[0]) & (b < at[1]))).orderBy(a.desc(), b.desc()).limit(n)


def intertime_histogram(revs: DataFrame, page: str, author: str, ts: str, order: list[str], bins: int = 12, seconds: int = 300) -> DataFrame:
    """Time between edits of different authors, in bins; a page's first edit falls in the last."""
    w = _by(page, order)
    passed = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    timed = revs.select(page, F.col(author).alias("_a"), F.lag(author).over(w).alias("_p"), passed.alias("_d"))
    bin_of = F.when(F.col("_d").isNull(), bins - 1).otherwise(F.least(F.lit(bins - 1), (F.col("_d") / seconds).cast("int")))
    return timed.where(F.col("_p").isNull() | (F.col("_p") != F.col("_a"))).withColumn("bin", bin_of).where("bin >= 0").groupBy(page, "bin").agg(F.count("*").alias("n"))


def revision_sizes(revs: DataFrame, page: str, author: str, text: str, order: list[str], last: int) -> DataFrame:
    """Author changes, total text and the text of the last revisions of each page."""
    w = _by(page, order)
    latest = Window.partitionBy(page).orderBy(*[F.desc(c) for c in order])
    marked = revs.select(page, F.length(text).alias("_l"), F.coalesce((F.lag(author).over(w) != F.col(author)).cast("int"), F.lit(1)).alias("_new"), F.row_number().over(latest).alias("_n"))
    return marked.groupBy(page).agg(F.sum("_new").alias("n_revisions"), F.sum("_l").alias("total_size"), F.sum(F.when(F.col("_n") <= last, F.col("_l"))).alias("last_size"))


def closest(pairs: DataFrame, key: str, distance: str, candidate: str) -> DataFrame:
    """Of each key's candidates the one at the least distance; of equals the first."""
    least = F.min(F.struct(F.col(distance).alias("d"), F.col(candidate).alias("c")))
    return pairs.groupBy(key).agg(least.alias("_m")).select(key, F.col("_m.c").alias("closest"), F.col("_m.d").alias("distance"))


def merged_lists(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The revisions of both lists, each once."""
    return a.unionByName(b).dropDuplicates(key)
