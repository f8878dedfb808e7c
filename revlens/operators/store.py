"""Statements on stored tables, as DataFrames in and out: lookups, upserts, queues, cascades.

A table that an operator changes comes back whole; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(revs: DataFrame, page: str, order: list[str]) -> DataFrame:
    """Each page's last row in the order of ``order``."""
    latest = Window.partitionBy(page).orderBy(*[F.desc(c) for c in order])
    return revs.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a list, however often it is there."""
    return rows.join(keys.select(key), key, "left_semi").select(rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in no row of a list."""
    return rows.join(keys.select(key), key, "left_anti").select(rows.columns)


def latest(*columns: DataFrame) -> DataFrame:
    """The greatest value of several one-column tables, as ``latest``."""
    each = [c.agg(F.max(F.col(c.columns[0])).alias("latest")) for c in columns]
    both = each[0]
    for c in each[1:]:
        both = both.unionByName(c)
    return both.agg(F.max("latest").alias("latest"))


def open_votes(votes: DataFrame, order: list[str], n: int) -> DataFrame:
    """The oldest votes that are not processed."""
    return first_rows(votes.where(~F.col("processed")), order, n)


def cast_votes(votes: DataFrame, order: list[str]) -> DataFrame:
    """Of the votes of one voter on one revision the first."""
    w = Window.partitionBy("revision", "voter").orderBy(*order)
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mark(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``rows`` with ``column`` set where ``keys`` has their key."""
    told = keys.select(key).distinct().withColumn("_told", F.lit(True))
    return rows.join(told, key, "left").withColumn(column, F.when(F.col("_told"), value).otherwise(F.col(column))).drop("_told").select(rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``table`` with ``changes`` in place of rows of the same key; of several changes the last by ``order``.

    Columns that ``changes`` lacks keep their values, new rows have null there.
    """
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    last = last.select(*key, *[F.col(c).alias(f"_new_{c}") for c in table.columns if c in changes.columns and c not in key], F.lit(True).alias("_changed"))
    value = lambda c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c not in key else F.col(c)
    return table.join(last, key, "full").select(*[value(c) for c in table.columns])


def worth_writing(increments: DataFrame, key: str, column: str, least: float = 0.001) -> DataFrame:
    """The sum of each key's increments where it changes anything: those of ``least`` or less, up or down, are not written.

    Sums are those of the increments' decimal digits, so none depends on the order of its rows; keys with increments that 38 digits
    do not hold are summed as doubles.
    """
    digits = F.col(column).try_cast("decimal(38,18)")
    exact = F.when(F.count(digits) == F.count(column), F.try_sum(digits).cast("double"))
    return increments.groupBy(key).agg(F.coalesce(exact, F.sum(column)).alias(column)).where(F.abs(column) > least)


def added(table: DataFrame, increments: DataFrame, key: str, column: str, start: float = 0.0) -> DataFrame:
    """``table`` with the sum of each key's increments; unknown keys begin at ``start``."""
    sums = increments.groupBy(key).agg(F.sum(column).alias("_sum"))
    return table.join(sums, key, "full").withColumn(column, F.coalesce(column, F.lit(start)) + F.coalesce("_sum", F.lit(0))).drop("_sum").select(table.columns)


def queue_front(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` waiting pages of highest priority, the longest waiting first among equals."""
    waiting = queue.where((F.col("state") == "unprocessed") & (F.col("priority") > 0))
    return waiting.orderBy(F.desc("priority"), "requested_on", "page").limit(n)


def dequeued(queue: DataFrame, taken: DataFrame, done: DataFrame) -> DataFrame:
    """The queue after pages were taken and others done: these leave it, those are being processed."""
    return mark(queue.join(done.select("page").distinct(), "page", "left_anti"), taken, "page", "state", F.lit("processing"))


def titles_renamed(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """``pages`` (page, title) under their new titles; a title that moves on leaves the page that had it without one."""
    moved = titles.select(F.col("title").alias("_title"), F.col("page").alias("_to"))
    freed = pages.join(moved, F.col("title") == F.col("_title"), "left").select("page", F.when(F.col("_to").isNull() | (F.col("_to") == F.col("page")), F.col("title")).alias("title"))
    return upsert(freed, titles.withColumn("_o", F.lit(0)), ["page"], ["_o"])


def without_pages(table: DataFrame, gone: DataFrame, page: str = "page") -> DataFrame:
    """A cascade's step: ``table`` without the rows of deleted pages."""
    return table.join(gone.select(F.col("page").alias(page)).distinct(), page, "left_anti")


def histogram_merged(stored: DataFrame, increments: DataFrame) -> DataFrame:
    """Stored slots plus increments of (slot, weight); none falls below 0."""
    return stored.unionByName(increments).groupBy("slot").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("weight"))


def user_numbers(users: DataFrame, names: DataFrame) -> DataFrame:
    """``users`` (user, name) with further numbers for names that it lacks, in the order of the names."""
    top = users.agg(F.coalesce(F.max("user"), F.lit(0)).alias("_top"))  # one row
    fresh = names.select("name").where("name is not null").distinct().join(users, "name", "left_anti")
    numbered = fresh.select("name", F.row_number().over(Window.orderBy("name")).alias("_n")).crossJoin(F.broadcast(top))
    return users.select("user", "name").unionByName(numbered.select((F.col("_top") + F.col("_n")).alias("user"), "name"))
