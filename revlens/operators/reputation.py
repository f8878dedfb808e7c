"""Reputation: as-of lookup, histograms, medians and quality of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_value(probes: DataFrame, history: DataFrame, key: str, ts: str, value: str, default: float) -> DataFrame:
    """Each probe with its key's last value strictly before it: one exchange of the union, no join."""
    left = probes.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast("double"))
    right = history.select(key, ts, F.col(value).cast("double").alias("_v")).withColumn("_side", F.lit(1))
    w = Window.partitionBy(key).orderBy(ts, "_side", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("as_of", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 0").withColumn("as_of", F.coalesce("as_of", F.lit(default))).drop("_side", "_v")


def with_first_bins(history: DataFrame, user: str = "user_id") -> DataFrame:
    """A history of bins (user, time, new_bin) with bin 0 for each user, one second before their first entry."""
    first = history.groupBy(user).agg((F.min("time") - 1).alias("time")).select(user, "time", F.lit(0).alias("new_bin"))
    return history.select(user, "time", "new_bin").unionByName(first)


def reputation_bin(rep: Column) -> Column:
    return F.ln(1 + F.greatest(rep, F.lit(0.0))).cast("int")


def reputation_histogram(users: DataFrame, rep: str) -> DataFrame:
    """Sum of the square roots of reputations by bin."""
    r = F.greatest(F.col(rep), F.lit(0.0))
    return users.groupBy(reputation_bin(F.col(rep)).alias("bin")).agg(F.sum(F.sqrt(r)).alias("weight"))


def high_median(histogram: DataFrame, share: float) -> DataFrame:
    """Where the cumulative weight reaches ``share`` of the total, interpolated within its bin."""
    w = Window.orderBy("bin")  # a row for each bin: a handful
    told = histogram.withColumn("upto", F.sum("weight").over(w)).crossJoin(F.broadcast(histogram.agg(F.sum("weight").alias("total"))))
    goal = share * F.col("total")
    first = told.where(F.col("upto") >= goal).orderBy("bin").limit(1)
    return first.select((F.col("bin") + F.try_divide(goal - (F.col("upto") - F.col("weight")), F.col("weight"))).alias("median"))


def high_median_of(histogram: Column, share: float) -> Column:
    """``high_median`` of an array of weights by bin; 0 where there is no weight."""
    goal = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x) * share
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("median"))

    def step(state: Column, x: Column) -> Column:
        left = goal - state["upto"]
        part = F.when(left <= 0, 0.0).when(x >= left, F.try_divide(left, x)).otherwise(1.0)
        return F.struct((state["upto"] + x).alias("upto"), (state["median"] + part).alias("median"))

    return F.aggregate(histogram, start, step)["median"]


def specific_quality(d01: Column, d02: Column, d12: Column) -> Column:
    """min(1, (d02 - d12) / d01); an edit that changed nothing is good."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(d02 - d12, d01)), F.lit(1.0))


def work_histogram(rows: DataFrame, weight: Column, work: Column, slots: int = 10) -> DataFrame:
    """Work by the slot of its author's weight; partial sums merge by addition."""
    slot = F.least(F.lit(slots - 1), F.greatest(F.lit(0), weight.cast("int")))
    return rows.groupBy(slot.alias("slot")).agg(F.sum(work).alias("work"))


def nixed_ratio(rows: DataFrame, key: str, nixes: Column) -> DataFrame:
    """How many revisions some judgement nixes; each revision counts once."""
    each = rows.groupBy(key).agg(F.bool_or(nixes).alias("_nixed"))
    return each.agg(F.count("*").alias("n_revisions"), F.count_if("_nixed").alias("n_nixed")).withColumn("ratio", F.try_divide("n_nixed", "n_revisions"))


def weight_of(reputation: Column, on_line: bool = True) -> Column:
    """What an author's reputation weighs: unknown ones as if it were 0 (on line) or 0.1."""
    if on_line:
        return F.ln(1.2 + F.greatest(F.coalesce(reputation, F.lit(0.0)), F.lit(0.0)))
    return F.ln(1 + F.greatest(F.coalesce(reputation, F.lit(0.1)), F.lit(0.0)))


def remembered(revs: DataFrame, order: list[str], n_trusted: int = 2, n_reputed: int = 2, least: float = 4.0) -> DataFrame:
    """(page, revision, kind): each page's revisions of highest trust, the later of equals, and the last ones of as many authors of high reputation."""
    back = [F.desc(c) for c in order]
    trusted = revs.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("trust"), *back))).where(F.col("_n") <= n_trusted)
    own_last = revs.where(F.col("reputation") > least).withColumn("_own", F.row_number().over(Window.partitionBy("page", "author").orderBy(*back))).where("_own = 1")
    reputed = own_last.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy(*back))).where(F.col("_n") <= n_reputed)
    return trusted.select("page", "revision", F.lit("trust").alias("kind")).union(reputed.select("page", "revision", F.lit("reputation")))
