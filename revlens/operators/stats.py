"""Statistics of quality against reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_column(q: Column) -> Column:
    """Column of a quality between -1 and 1: 0 is the best, 10 the worst."""
    return ((1 - q) / 0.2).cast("int")


def quality_matrix(rows: DataFrame, bin: Column, q: Column, weight: Column) -> DataFrame:
    return rows.groupBy(bin.alias("bin"), quality_column(q).alias("col")).agg(F.sum(weight).alias("weight"))


def cumulative(matrix: DataFrame) -> DataFrame:
    """Share of a bin's weight at a column or worse."""
    worse = Window.partitionBy("bin").orderBy(F.desc("col")).rowsBetween(Window.unboundedPreceding, 0)
    return matrix.select("bin", "col", (F.sum("weight").over(worse) / F.sum("weight").over(Window.partitionBy("bin"))).alias("share"))


def percentages(matrix: DataFrame) -> DataFrame:
    """(bin, col, weight, of_all, of_bin, of_col): each cell's weight as a share of everything, of its bin and of its column."""
    whole = matrix.agg(F.sum("weight").alias("_all"))
    share = lambda *by: F.try_divide("weight", F.sum("weight").over(Window.partitionBy(*by)))
    return matrix.join(F.broadcast(whole)).select("bin", "col", "weight", F.try_divide("weight", "_all").alias("of_all"), share("bin").alias("of_bin"), share("col").alias("of_col"))  # one row is sent


def word_frequency(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, n), the most frequent first, equals in the order of words."""
    return words.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.desc("n"), word)


def write_days(rows: DataFrame, table: str, path: str, ts: str, buckets: int = 64) -> DataFrame:
    """``rows`` as a table of ``buckets`` buckets by day, each sorted by day and time; what it reads as.

    Statements by day and windows of a day read it without an exchange.
    """
    day = F.date_trunc("day", ts)
    dated = rows.withColumn("day", day)
    # one file for each bucket, as the bucketing deals it
    dated.repartition(buckets, "day").write.bucketBy(buckets, "day").sortBy("day", ts).option("path", path).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def precision_recall(matrix: DataFrame, low_bin: int, bad_col: int) -> DataFrame:
    """How well a low bin tells bad columns."""
    low, bad = F.col("bin") < low_bin, F.col("col") >= bad_col
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0))
    sums = matrix.agg(total(low & bad).alias("hit"), total(low).alias("low"), total(bad).alias("bad"), F.sum("weight").alias("all"))
    return sums.select(F.try_divide("hit", "low").alias("precision"), F.try_divide("hit", "bad").alias("recall"), F.try_divide(F.col("hit") * F.col("all"), F.col("low") * F.col("bad")).alias("boost"))


def information(matrix: DataFrame, low_bin: int, bad_col: int) -> DataFrame:
    """What a low bin tells of bad columns, in bits: the mutual information, the entropies of both, and the former as a share of the bins' entropy."""
    low, bad = F.col("bin") < low_bin, F.col("col") >= bad_col
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)) / F.sum("weight")
    cells = {"bad_low": low & bad, "bad_high": ~low & bad, "good_low": low & ~bad, "good_high": ~low & ~bad}
    p = matrix.agg(*[share(c).alias(name) for name, c in cells.items()])
    p = p.select("*", *[sum((F.col(c) for c in cells if side in c.split("_")), F.lit(0.0)).alias(side) for side in ("bad", "good", "low", "high")])
    told = lambda c, against: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / against)).otherwise(0.0)
    both = sum((told(c, F.col(c.split("_")[0]) * F.col(c.split("_")[1])) for c in cells), F.lit(0.0))
    entropy = lambda *sides: -sum((told(c, F.lit(1.0)) for c in sides), F.lit(0.0))
    out = p.select(both.alias("mutual_information"), entropy("bad", "good").alias("entropy_bad"), entropy("low", "high").alias("entropy_low"))
    return out.withColumn("constraint_coefficient", F.try_divide("mutual_information", "entropy_low"))


def judgements(rows: DataFrame, key: str, q: Column, weight: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_judges"), F.sum(weight).alias("judge_weight"), F.sum(q * weight).alias("total_quality"), F.min(q).alias("min_quality"))


def quality_events(edits: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, time, rep, weight, quality) for the statistics: an edit weighs its change times its judges, a text its new words.

    ``edits`` has time, author, rep, delta, n_judges and avg_quality, ``texts`` time,
    author, rep, new_text and decay.  What changes or adds nothing and anonymous authors (0) are left out; qualities end at -1 and 1.
    """
    bounded = lambda q: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(q).cast("double")))
    of_edits = edits.where("author <> 0 and delta > 0").select(F.lit("edit").alias("kind"), "time", "rep", (F.col("delta") * F.col("n_judges")).cast("double").alias("weight"), bounded("avg_quality").alias("quality"))
    of_texts = texts.where("author <> 0 and new_text > 0").select(F.lit("text").alias("kind"), "time", "rep", F.col("new_text").cast("double").alias("weight"), bounded("decay").alias("quality"))
    return of_edits.union(of_texts)


def by_month(events: DataFrame, total: bool = False) -> DataFrame:
    """(kind, month, n, weight, quality): weighted quality by month, or up to each month."""
    months = events.groupBy("kind", F.date_trunc("month", "time").alias("month")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("quality")).alias("product"))
    if total:
        w = Window.partitionBy("kind").orderBy("month")
        months = months.select("kind", "month", *[F.sum(c).over(w).alias(c) for c in ("n", "weight", "product")])
    return months.select("kind", "month", "n", "weight", F.try_divide("product", "weight").alias("quality"))
