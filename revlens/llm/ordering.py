"""Places of rows in an order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of ranges' counts that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
_ROW_BITS = 33  # of ``monotonically_increasing_id``: below them the partition's number


def numbered(df: DataFrame, group: str, *by: Column) -> DataFrame:
    """``df`` with ``idx``, a row's place (from 0) among those of its group in the order ``by``, and ``n``, their number.

    Rows are dealt out by ranges of the whole order, sorted within a range and
    written.  Each range counts its rows of each group; the counts of the
    ranges before it are where its own begin.
    """
    keys = [F.col(group), *by]
    runs = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    runs = runs.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    counts = runs.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = cut(counts.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_begin"), F.sum("_n").over(own).alias("n")))
    if begins.count() <= BROADCAST_ROWS:  # a row for each range and group that meet
        begins = F.broadcast(begins)
    return runs.join(begins, [group, "_part"]).select(*df.columns, (F.col("_row") + F.col("_begin")).alias("idx"), "n")
