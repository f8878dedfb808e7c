"""Judging revisions by later ones, and the reputations that follow.

A judgement looks at three revisions of a page: v0, then v1 that is judged, then v2 by
another author, the judge.  ``d01`` etc. are edit distances between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import in_order
from . import settling
from .reputation import high_median_of, specific_quality


def _numbered(revs: DataFrame, order: list[str], who: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("page").orderBy(*order))
    more = [F.size("words").alias("n_words")] if "words" in revs.columns else []
    return revs.select("page", n.alias("n"), F.struct("revision", "author", "ts", F.col(who).alias("who"), *more).alias("v"))


def _with_near(revs: DataFrame, distances: DataFrame, order: list[str], who: str) -> DataFrame:
    """(page, n, v, near): each revision, and those before it whose distance from it is known, by their number."""
    rows = _numbered(revs, order, who)
    named = rows.select("page", F.col("v.revision").alias("revision"), "n", "v")
    earlier = distances.select("page", F.col("a").alias("revision"), "b", F.col("distance").alias("d")).join(named, ["page", "revision"])
    near = earlier.groupBy("page", F.col("b").alias("revision")).agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("d", "v")))).alias("near"))
    return named.join(near, ["page", "revision"], "left").select("page", "n", "v", "near")


def _judging(revs: DataFrame, distances: DataFrame, order: list[str], horizon: int, who: str) -> DataFrame:
    """(page, n1, v1, near1, n2, v2, near2) of each revision and each of the next ``horizon``: one join by place."""
    each = _with_near(revs, distances, order, who)
    judged = each.select("page", F.col("n").alias("n1"), F.col("v").alias("v1"), F.col("near").alias("near1"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + horizon)).alias("n2"))
    judges = each.select("page", F.col("n").alias("n2"), F.col("v").alias("v2"), F.col("near").alias("near2"))
    return judged.join(judges, ["page", "n2"])


def _apart(a: str, b: str) -> Column:
    return ~F.col(f"{a}.who").eqNullSafe(F.col(f"{b}.who"))


def judgements(revs: DataFrame, distances: DataFrame, order: list[str], horizon: int, who: str = "author") -> DataFrame:
    """One row per (v0, v1, v2) within ``horizon`` revisions, v2 not by v1's author.

    ``revs`` has page, revision, author, ts, and ``who``, which tells authors
    apart; ``distances`` has page, a, b (revisions, the earlier first) and distance.  ``delta`` is the distance
    of v1 from the revision before it, ``dp2`` that one's from v2; n01, n12, t01, t12 are
    the revisions and seconds between.  Rows without one of the distances are left out.
    """
    met = _judging(revs, distances, order, horizon, who).where(_apart("v1", "v2")).select("*", F.explode("near1").alias("n0", "first"))
    met = met.where(F.col("n2") - F.col("n0") <= horizon)
    d = lambda near, n: F.try_element_at(near, n)["d"]
    passed = lambda a, b: (F.unix_timestamp(b["ts"]) - F.unix_timestamp(a["ts"])).cast("double")
    v0, v1, v2 = F.col("first.v"), F.col("v1"), F.col("v2")
    named = [v[c].alias(f"{c}{k}") for k, v in enumerate((v0, v1, v2)) for c in ("revision", "author")]
    told = met.select(
        "page", *named, v2["ts"].alias("ts"), d(F.col("near1"), F.col("n1") - 1).alias("delta"), F.col("first.d").alias("d01"), d(F.col("near2"), F.col("n0")).alias("d02"), d(F.col("near2"), F.col("n1")).alias("d12"), d(F.col("near2"), F.col("n1") - 1).alias("dp2"),
        (F.col("n1") - F.col("n0")).alias("n01"), (F.col("n2") - F.col("n1")).alias("n12"), passed(v0, v1).alias("t01"), passed(v1, v2).alias("t12"),
    )
    return told.dropna(subset=["delta", "d01", "d02", "d12", "dp2"])


def text_judgements(told: DataFrame, order: list[str], horizon: int, who: str = "author") -> DataFrame:
    """One row per (v0, v1) within ``horizon`` revisions and by different authors: v0's new words, and how many of them v1 shows.

    ``told`` are tracked words (page, revision, author, ts, n_new, origin).
    """
    rows = _numbered(told.select("*"), order, who).select("page", "n", "v")
    sized = told.select("page", "revision", "n_new")
    seen = told.select("page", F.col("revision").alias("revision1"), F.explode("origin").alias("revision0")).groupBy("page", "revision1", "revision0").agg(F.count("*").alias("left"))
    first = rows.select("page", F.col("n").alias("n0"), F.col("v").alias("v0"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + horizon)).alias("n1"))
    second = rows.select("page", F.col("n").alias("n1"), F.col("v").alias("v1"))
    pairs = first.join(second, ["page", "n1"]).where(_apart("v0", "v1"))
    flat = pairs.select("page", *[F.col(f"v{k}.{c}").alias(f"{c}{k}") for k in (0, 1) for c in ("revision", "author", "ts")], (F.col("n1") - F.col("n0")).alias("n01"))
    joined = flat.join(seen, ["page", "revision1", "revision0"], "left").join(sized.select("page", F.col("revision").alias("revision0"), F.col("n_new").alias("text")), ["page", "revision0"])
    seconds = (F.unix_timestamp("ts1") - F.unix_timestamp("ts0")).cast("double")
    return joined.select("page", "revision0", "author0", "ts0", "revision1", "author1", F.col("ts1").alias("ts"), "text", F.coalesce("left", F.lit(0)).cast("long").alias("left"), "n01", seconds.alias("t01"))


def text_lives(told: DataFrame, order: list[str], horizon: int, who: str = "author") -> DataFrame:
    """(page, revision, new_text, n_judges, text_life): for each revision its new words, and how many of them others of the next ``horizon`` show in all."""
    judged = text_judgements(told, order, horizon, who).groupBy("page", F.col("revision0").alias("revision")).agg(F.count("*").alias("n_judges"), F.sum("left").alias("text_life"))
    rows = told.select("page", "revision", F.col("n_new").alias("new_text")).join(judged, ["page", "revision"], "left")
    return rows.select("page", "revision", "new_text", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_judges", "text_life")])


def edit_lives(judged: DataFrame) -> DataFrame:
    """(page, revision, n_judges, delta, avg_quality) of revisions that changed something, judged against the revision before."""
    own = judged.where("n01 = 1 and delta > 0").withColumn("q", specific_quality(F.col("d01"), F.col("d02"), F.col("d12")))
    return own.groupBy("page", F.col("revision1").alias("revision")).agg(F.count("*").alias("n_judges"), F.max("delta").alias("delta"), F.avg("q").alias("avg_quality"))


def closest_judgements(judged: DataFrame, weight: Column) -> DataFrame:
    """For each judged and judging revision the judgement from the earlier revision closest to the judge, the later of equals.

    Returns quality between -1 and 1 (1 if v0 and v1 are alike), judge_weight
    (less the farther the judge stands from both) and delta, the least distance of v1 from an earlier revision; those without any change are left out.
    """
    best = F.min(F.struct("d02", "n01", "d01", "d12", "revision0", "author0"))
    each = judged.groupBy("page", "revision1", "author1", "revision2", "author2").agg(best.alias("c"), F.min("d01").alias("delta"), F.max("ts").alias("ts"), F.max("t12").alias("t12"))
    d01, d02, d12 = F.col("c.d01"), F.col("c.d02"), F.col("c.d12")
    q = F.when(d01 == 0, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(d02 - d12, d01))))
    told = each.where("delta > 0").select("page", "revision1", "author1", "revision2", "author2", "ts", "t12", "delta", F.col("c.revision0").alias("closest"), q.alias("quality"), F.least(d02, d12).alias("_near"), d01.alias("_d01"))
    return told.withColumn("judge_weight", weight * F.exp(-F.col("_near") / (1 + F.col("_d01")) / 3)).drop("_near", "_d01")


# --- reputation -------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    # The scale of increments and the reputation of the unknown.
    scale: float = 73.24
    initial: float = 0.1
    most: float = 22026.0
    nix_seconds: float = 86400.0
    judges: int = 10
    capped: bool = True
    weak_nix: bool = False
    truthful: str | None = None  # None, "truthful" or "almost"


def eligible(judged: DataFrame, robots: DataFrame, start: Column, end: Column, anonymous: bool = False, local: bool = False, domains: bool = False) -> DataFrame:
    """Judgements that count: something changed, in time, by a known author, not by a robot; ``local`` only those from the revision before.

    With ``domains`` anonymous authors are known by the domain of their address: ``domain0`` to ``domain2``, as ``functions.text.ip_domain_id`` gives it.
    """
    if domains:
        judged = judged.withColumns({f"author{k}": F.when(F.col(f"author{k}") == 0, F.coalesce(f"domain{k}", F.lit(0))).otherwise(F.col(f"author{k}")) for k in range(3)})
    rows = judged.join(robots.select(F.col("author").alias("author2")), "author2", "left_anti")
    rows = rows.where((F.col("d01") > 0) & (F.col("delta") > 0) & F.col("ts").between(start, end) & (F.col("author1") != F.col("author2")))
    rows = rows if anonymous else rows.where("author1 <> 0")
    return rows.where("n01 = 1") if local else rows


def quality_of(rule: Rules) -> Column:
    q = specific_quality(F.col("d01"), F.col("d02"), F.col("d12"))
    if rule.truthful == "truthful":
        return F.when(F.col("n01") == 1, q).otherwise(0.0)
    if rule.truthful == "almost":
        return F.least(q, specific_quality(F.col("delta"), F.col("dp2"), F.col("d12")))
    return q


def hasty(rule: Rules) -> Column:
    """Too many revisions in too short a time."""
    return (F.col("n01") + F.col("n12") >= rule.judges) & (F.col("t01") + F.col("t12") <= rule.nix_seconds)


def nixes(rule: Rules) -> Column:
    """Whether a judgement nixes its revision; rep0, rep1, rep2 are the reputations at its time."""
    bad = (specific_quality(F.col("d01"), F.col("d02"), F.col("d12")) < 0) & (F.col("t12") <= rule.nix_seconds)
    by_better = (F.col("rep2") > F.col("rep1")) & (F.col("rep0") > F.col("rep1"))
    return (bad & (F.lit(rule.weak_nix) | by_better)) | hasty(rule)


def increment(rule: Rules) -> Column:
    """What a judgement adds to v1's author, before scaling; needs rep0, rep1, rep2, quality and nixed.

    A praise counts in full only if it comes late and the revision was not
    nixed; else it lifts no author above the lesser of v0's and the judge's.
    """
    proposed = F.col("delta") * F.col("quality") * F.ln(1 + F.greatest("rep2", F.lit(0.0)))
    if not rule.capped:
        return proposed
    free = (proposed < 0) | ((F.col("t12") > rule.nix_seconds) & ~F.col("nixed"))
    lifted = F.greatest("rep1", F.least(F.least("rep0", "rep2"), proposed + F.col("rep1"))) - F.col("rep1")
    return F.when(free, proposed).otherwise(lifted)


def _accumulated(batches: Iterator[pd.DataFrame], rule: Rules) -> Iterator[pd.DataFrame]:
    """Reputation after each increment; rows come sorted by author and time."""
    author, rep = None, rule.initial
    for pdf in batches:
        out = np.zeros(len(pdf))
        for k, (a, start, inc) in enumerate(zip(pdf["author"], pdf["start1"], pdf["inc"], strict=True)):
            if a != author:
                author, rep = a, start
            rep = int(max(0.0, min(rule.most, rep + inc / rule.scale)) * 100 + 1e-9) / 100
            out[k] = rep
        yield pdf.drop(columns=["inc", "start1"]).assign(rep=out)


def reputations(events: DataFrame, number: str, rule: Rules = Rules(), block: int = settling.BLOCK) -> DataFrame:
    """History (author, n, rep, ts): the reputation of authors after each judgement of them, as one pass in the order of ``number`` has it.

    ``settling.settled`` does it by rounds over all authors; a revision stays nixed once a judgement has nixed it.
    """
    rows = events.where("author1 <> 0").withColumn("quality", quality_of(rule)).withColumn("n", F.col(number).cast("long"))
    before = Window.partitionBy("revision1").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)

    def step(known: DataFrame, fixed: DataFrame | None, earlier: DataFrame | None) -> DataFrame:
        judged = known.withColumn("nixes", nixes(rule)).withColumn("nixed", F.max("nixes").over(before))
        for history in (fixed, earlier):
            if history is not None:
                past = history.where("nixes").select("revision1", F.lit(True).alias("_past")).distinct()
                judged = judged.join(past, "revision1", "left").withColumn("nixed", F.col("nixed") | F.coalesce("_past", F.lit(False))).drop("_past")
        steps = judged.select(F.col("author1").alias("author"), "n", "revision1", "nixes", "ts", "start1", F.when(F.col("quality") == 0, 0.0).otherwise(increment(rule)).alias("inc"))
        dealt = steps.repartition("author").sortWithinPartitions("author", "n")
        return dealt.mapInPandas(lambda it: _accumulated(it, rule), "author long, n long, revision1 long, nixes boolean, ts timestamp, rep double")

    wanted = ["n", "quality", "ts", "revision1", *[f"author{k}" for k in range(3)], "delta", "d01", "d02", "d12", "dp2", "n01", "n12", "t01", "t12"]
    return settling.settled(rows.select(*wanted), step, 3, rule.initial, block).select("author", "n", "rep", "ts")


# --- on line ----------------------------------------------------------------------


@dataclass(frozen=True)
class OnLine:
    # Revisions looked at, the scale of weights, the share of work below the median that lifts weights, and bounds.
    consider: int = 8
    slots: int = 10
    boost_share: float = 0.7
    most: float = 22024.465795
    nix_seconds: float = 86400.0
    nix_below: float = 0.1

    def scaling(self, recent: Column) -> Column:
        """One over the number of revisions that a judge of a page of so many recent revisions judges."""
        return 1.0 / F.greatest(F.lit(1), F.least(recent - 2, F.lit(self.consider // 2)))


_NOBODY = -1


def _mid(q: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q))


def on_line_judgements(revs: DataFrame, distances: DataFrame, order: list[str], robots: DataFrame, rule: OnLine = OnLine()) -> DataFrame:
    """What each revision of a page, as a judge, says of the recent ones; ``counts`` tells which are by other known authors and changed something.

    Of a judge's ``recent`` revisions (itself included, ``consider`` at
    most) it judges all but the oldest; on a shorter page that one too, against an
    empty text before the page's start (``starts``) by somebody of the greatest reputation.  ``c`` is the revision before the judged
    one that is closest to the judge, the later of equals, ``delta`` the judged one's least distance from any of them.
    """
    deep = rule.consider - 1
    met = _judging(revs, distances, order, deep, "author").join(robots.select(F.col("author").alias("_robot")), F.col("v2.author") == F.col("_robot"), "left_anti")
    met = met.withColumn("recent", F.least(F.lit(rule.consider), F.col("n2"))).withColumn("oldest", F.col("n2") - F.col("recent") + 1)
    met = met.withColumn("starts", (F.col("n1") == 1) & (F.col("recent") < rule.consider))
    met = met.where(F.col("starts") | ((F.col("n1") > F.col("oldest")) & (F.col("n1") > 1)))
    recents = F.filter(F.map_entries("near2"), lambda e: e["key"] >= F.col("oldest"))
    before = F.filter(recents, lambda e: e["key"] < F.col("n1"))
    closest = F.array_min(F.transform(before, lambda e: F.struct(e["value"]["d"].alias("d"), (-e["key"]).alias("n"))))
    far = F.array_min(F.transform(F.filter(F.map_entries("near1"), lambda e: e["key"] >= F.col("oldest")), lambda e: e["value"]["d"]))
    met = met.withColumn("work", F.array_min(F.transform(recents, lambda e: e["value"]["d"]))).withColumn("c", closest).withColumn("far", far)
    at = lambda near, n: F.try_element_at(near, n)
    near1, near2, cn, size1, size2 = F.col("near1"), F.col("near2"), -F.col("c.n"), F.col("v1.n_words").cast("double"), F.col("v2.n_words").cast("double")
    start = lambda here, other: F.when(F.col("starts"), here).otherwise(other)
    oldest = F.when(F.col("oldest") == F.col("n1"), F.col("v1.ts")).otherwise(at(near2, F.col("oldest"))["v"]["ts"])
    seconds = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)).cast("double")
    told = met.select(
        "page", F.col("v1.revision").alias("revision1"), F.col("v2.revision").alias("revision2"), F.col("v2.ts").alias("ts"), (F.col("n2") - F.col("n1")).alias("back"), "recent", "starts", "work",
        F.coalesce("v2.author", F.lit(0)).cast("long").alias("author0"), F.coalesce("v1.author", F.lit(0)).cast("long").alias("author1"), start(F.lit(0).cast("long"), at(near2, cn)["v"]["author"]).alias("author2"), start(F.lit(0).cast("long"), at(near1, F.col("n1") - 1)["v"]["author"]).alias("author3"),
        start(size1, F.col("far")).alias("delta"), start(size1, at(near1, cn)["d"]).alias("dc1"), start(size2, F.col("c.d")).alias("dc2"), at(near2, F.col("n1"))["d"].alias("d12"),
        start(F.lit(0.0), at(near1, F.col("n1") - 1)["d"]).alias("dp1"), start(F.lit(0.0), at(near2, F.col("n1") - 1)["d"]).alias("dp2"), seconds(F.col("v1.ts"), F.col("v2.ts")).alias("t12"), seconds(oldest, F.col("v1.ts")).alias("t_old1"), seconds(oldest, F.col("v2.ts")).alias("t_old2"),
    )
    q = F.when(F.col("dc1") > 0, _mid((F.col("dc2") - F.col("d12")) / F.col("dc1"))).otherwise(1.0)
    local = F.when(F.col("dp1") > 0, _mid((F.col("dp2") - F.col("d12")) / F.col("dp1"))).otherwise(1.0)
    hasty = (F.col("recent") >= rule.consider) & (F.col("t_old1") < rule.nix_seconds)
    counts = F.coalesce((F.col("author1") != 0) & (F.col("author0") != F.col("author1")) & (F.col("delta") > 0), F.lit(False))
    nixes = counts & (F.col("t12") < rule.nix_seconds) & ((q <= rule.nix_below) | hasty)
    return told.withColumns({"q": q, "q_local": local, "nixes": nixes, "counts": counts})


def _lifted(batches: Iterator[pd.DataFrame], rule: OnLine) -> Iterator[pd.DataFrame]:
    """Each author's reputation after each judgement; rows come sorted by author and time."""
    author, rep = None, 0.0
    for pdf in batches:
        out = np.zeros(len(pdf))
        for k, r in enumerate(pdf.itertuples(index=False)):
            if r.author != author:
                author, rep = r.author, r.start1
            # by the revision just before, never above the lesser of its author and the judge
            near = rep if r.starts else max(rep, min(r.rep0, r.rep3, rep + r.scaling * r.dp1 * r.q_local * r.weight))
            inc = min(r.scaling * r.delta * r.q * r.weight, rule.most)
            if inc < 0:
                rep = max(0.0, rep + inc)
            elif inc > 0 and (r.nixed or r.t12 < rule.nix_seconds):
                cap = min(r.rep0, r.rep_c if r.t_old2 < rule.nix_seconds else r.rep0)
                rep = max(rep, near, min(cap, rep + inc))
            else:
                rep = max(near, rep + inc)
            out[k] = rep
        yield pdf[["n"]].assign(rep=out)


def on_line_reputations(judged: DataFrame, rule: OnLine = OnLine(), block: int = settling.BLOCK) -> DataFrame:
    """History (author, n, revision1, revision2, rep) of on-line reputations, from nothing, as one pass over the judges in the order of time has it.

    Judges weigh more while the work of a wiki is done by authors of little
    weight: their weight is stretched so that the high median of all work before is the
    greatest weight.  Increments are capped by the judge, and by who wrote what lies close, where they come early.
    """
    rows = in_order(judged, "n", "ts", "revision2", "back")
    own = Window.partitionBy("revision2")
    nixed = F.max("nixes").over(Window.partitionBy("revision1").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("event", F.min("n").over(own)).withColumn("nixed", nixed)

    def step(known: DataFrame, fixed: DataFrame | None, earlier: DataFrame | None) -> DataFrame:
        weighed = known.withColumn("w", F.ln(1.2 + F.col("rep0")))
        slot = F.greatest(F.lit(0), F.least(F.lit(rule.slots - 1), F.col("w").cast("int")))
        first = (F.col("n") == F.col("event")) & (F.col("author0") != 0)
        works = weighed.select("n", "event", *[F.when(first & (slot == k), F.col("work")).otherwise(0.0).alias(f"_{k}") for k in range(rule.slots)])
        names = [f"_{k}" for k in range(rule.slots)]
        past = [h.select("n", "event", *names) for h in (fixed, earlier) if h is not None]
        before = past[0].unionByName(past[1]) if len(past) > 1 else past[0] if past else None
        start = F.struct(*[F.lit(x or 0.0).alias(c) for c, x in zip(names, before.agg(*[F.sum(c) for c in names]).first(), strict=True)]) if before is not None else F.struct(*[F.lit(0.0).alias(c) for c in names])
        # running sums: within a range of numbers, and of all ranges before it
        parts = works.groupBy(F.shiftright("event", 33).alias("part")).agg(*[F.sum(c).alias(c) for c in names])
        upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        parts = parts.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(f"p{c}") for c in names])
        within = Window.partitionBy("part").orderBy("event").rangeBetween(Window.unboundedPreceding, -1)
        sums = works.withColumn("part", F.shiftright("event", 33)).select("n", "part", *names, *[F.coalesce(F.sum(c).over(within), F.lit(0.0)).alias(f"w{c}") for c in names]).join(F.broadcast(parts), "part")
        histogram = F.array(*[F.col(f"w{c}") + F.col(f"p{c}") + start[c] for c in names])
        told = weighed.join(sums.select("n", *names, high_median_of(histogram, rule.boost_share).alias("median")), "n")
        lifted = F.when(F.col("median") > 0, F.least(F.col("w") * rule.slots / F.col("median"), F.lit(float(rule.slots)))).otherwise(float(rule.slots))
        steps = told.select(
            F.col("author1").alias("author"), "n", "revision1", "revision2", "start1", "starts", "rep0", "rep3", F.when(F.col("starts"), rule.most).otherwise(F.col("rep2")).alias("rep_c"), rule.scaling(F.col("recent")).alias("scaling"),
            "delta", "q", "dp1", "q_local", "t12", "t_old2", "nixed", "counts", F.greatest("w", lifted).alias("weight"),
        )
        dealt = steps.where("counts").drop("counts").repartition("author").sortWithinPartitions("author", "n")
        after = dealt.mapInPandas(lambda it: _lifted(it, rule), "n long, rep double")
        # a judge's work counts in any case; nobody has the number of those who are judged in vain
        whose = F.when(F.col("counts"), F.col("author1")).otherwise(_NOBODY).alias("author")
        return told.select(whose, "n", "revision1", "revision2", "event", *names).join(after, "n", "left").withColumn("rep", F.coalesce("rep", F.lit(0.0)))

    history = settling.settled(rows, step, 4, 0.0, block)
    return history.where(F.col("author") != _NOBODY).select("author", "n", "revision1", "revision2", "rep")


def final_reputations(history: DataFrame, names: DataFrame) -> DataFrame:
    """Lines ``0. author -1 bin reputation "name"`` of authors above zero, for a reputation file."""
    last = history.groupBy("author").agg(F.max_by("rep", "n").alias("rep")).withColumn("bin", F.ln(1 + F.col("rep")).cast("int"))
    told = last.where("bin > 0 or rep > 0").join(names, "author", "left")
    return told.select(F.format_string('%f %d %d %d %f "%s"', F.lit(0.0), "author", F.lit(-1), "bin", "rep", F.coalesce("name", F.lit(""))).alias("value"))
