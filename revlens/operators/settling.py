"""Folds in time over all authors at once, by rounds that settle.

A judgement weighs as reputations do at its moment, and they follow from the
judgements before it: one ordered pass over everything.  Here each round
evaluates many judgements at once with the reputations that the round before came to.
What no changed judgement precedes is final, so the settled front moves on in
every round; only what lies behind it is evaluated again.  The result is
that of the ordered pass, however many rounds that takes.

Judgements are taken in blocks of time, so that a round's work is bounded
by a block, and what is known at a block's end is one row for each author.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, written

BLOCK = 500_000
_BASE, _TOLD = 8, 9  # roles of what is known before and of guesses; a role of a judgement is below


def as_of(rows: DataFrame, told: DataFrame, base: DataFrame, roles: int, initial: float) -> DataFrame:
    """``rows`` (n, author0, author1 ...) with ``rep0`` ... just before each, and ``start1``, what author1 had before all of ``told``.

    ``told`` has author, n and rep, ``base`` author and rep.  Author 0 has ``initial`` throughout.
    """
    payload = F.struct(*rows.columns)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(f"author{k}").alias("author")) for k in range(roles)]))
    none = F.lit(None).cast("double")
    probes = rows.select("n", payload.alias("row"), each.alias("r")).select("r.author", "n", "r.role", none.alias("rep"), F.when(F.col("r.role") == 1, F.col("row")).alias("row"))
    known = told.select("author", "n", F.lit(_TOLD).alias("role"), "rep").unionByName(base.select("author", F.lit(-(1 << 62)).alias("n"), F.lit(_BASE).alias("role"), "rep"))
    both = probes.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy("author").orderBy("n", "role").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("rep", ignorenulls=True).over(w), F.lit(initial))
    start = F.coalesce(F.last(F.when(F.col("role") == _BASE, F.col("rep")), ignorenulls=True).over(w), F.lit(initial))
    seen = both.withColumn("at", F.when(F.col("author") == 0, initial).otherwise(last)).withColumn("start", start).where(F.col("role") < _BASE)
    of = lambda k, c: F.max(F.when(F.col("role") == k, F.col(c)))
    one = seen.groupBy("n").agg(F.first("row", ignorenulls=True).alias("row"), of(1, "start").alias("start1"), *[of(k, "at").alias(f"rep{k}") for k in range(roles)])
    return one.select("row.*", "start1", *[f"rep{k}" for k in range(roles)])


def _latest(base: DataFrame, told: DataFrame) -> DataFrame:
    """Each author's last reputation."""
    both = told.select("author", "n", "rep").unionByName(base.select("author", F.lit(-(1 << 62)).alias("n"), "rep"))
    return both.groupBy("author").agg(F.max_by("rep", "n").alias("rep"))


def _bounds(rows: DataFrame, block: int) -> list[int]:
    """The last number of each block; some numbers for many rows."""
    total, most = rows.agg(F.count("*"), F.max("n")).first()
    parts = max(1, -(-total // block))
    inner = rows.approxQuantile("n", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({*map(int, inner), most}) if total else []


def settled(rows: DataFrame, step: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame], roles: int, initial: float, block: int = BLOCK) -> DataFrame:
    """History (author, n, rep and what else ``step`` tells) of author1 of every row.

    ``rows`` has n (unique, in the order of time) and author0, author1 ...;
    ``step(known, fixed, earlier)`` gets rows that are not yet final with
    the reputations as of each, the final history of their block, and that of the blocks
    before (None for the first).
    """
    rows = written(rows)
    base = written(rows.select(F.col("author1").alias("author"), F.lit(initial).alias("rep")).limit(0))
    earlier, lower = None, None
    for upper in _bounds(rows, block):
        own = rows.where(F.col("n") <= upper) if lower is None else rows.where((F.col("n") > lower) & (F.col("n") <= upper))
        history, front = None, None
        while True:
            final = history.where(F.col("n") <= front) if history is not None else None
            rest = own if front is None else own.where(F.col("n") > front)
            start = base if final is None else _latest(base, final)
            guesses = (history.where(F.col("n") > front) if history is not None else base.withColumn("n", F.lit(0).cast("long")).limit(0)).select("author", "n", "rep")
            new = step(as_of(rest, guesses, start, roles, initial), final, earlier)
            following = written(new if final is None else final.unionByName(new))
            if history is None:
                moved = following.agg(F.min("n")).first()[0]
                moved = None if moved is None else moved - 1  # nothing is known yet
            else:
                was = history.where(F.col("n") > front).select("n", F.col("rep").alias("was"))
                changed = following.where(F.col("n") > front).join(was, "n", "left").where("was is null or abs(rep - was) > 1e-9")
                moved = changed.agg(F.min("n")).first()[0]
            dropped(history)
            history = following
            if moved is None:
                break
            if front is not None and moved <= front:
                raise RuntimeError(f"judgement {moved} changed although all before it were final")
            front = moved
        base, before = written(_latest(base, history)), base
        dropped(before)
        earlier = history if earlier is None else earlier.unionByName(history)
        lower = upper
    return earlier if earlier is not None else step(as_of(rows, base.withColumn("n", F.lit(0).cast("long")), base, roles, initial), None, None)
