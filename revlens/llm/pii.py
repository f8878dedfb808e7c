"""Personal data by weak supervision, with DataFrame and SQL functions only.

Patterns propose candidate spans: the base patterns, and looser ones
(national phone numbers, bracketed e-mail addresses, digit groups that fail
a check).  Five labelers vote on each candidate, for (1), against (-1) or
not at all (0): the base rule, the characters next to it, a gazetteer
(domains, country codes, card issuers, reserved networks), words before it,
and its digits.  Votes of all documents are counted by pattern - a table of
at most ``4 * 3^5`` rows - from which expectation-maximisation estimates
each labeler's reliability and the patterns' probabilities; a logistic
span classifier is trained on these and decides.  Spans of the base rule
always stay; others are added if the classifier gives ``MIN_PROBABILITY``
and they overlap no span of the base rule and no candidate before them.

Places are counted from the lengths of matches and of the text between
them, so a text is read once for each pattern, and only texts that have a
digit or an at sign are read at all.  The patterns hold no loop that tries
one stretch twice, so long texts take linear time.

Null and empty texts have no spans.  Every row is judged by itself, rows
without a doc_id and repeated ones included; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, set_aside

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "edge", "gazetteer", "context", "digits")
MIN_PROBABILITY = 0.9
EM_ROUNDS = 100
BEFORE_CHARS = 24

#: The base patterns, each run of a class taken at once; a match begins where a run does or where the last match ended.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Looser patterns, of candidates that the base rule never takes.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++){1,4}"),
    ("phone", r"(?<![0-9+().-])(?<![0-9+)]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)

# Top-level domains, country calling codes, and words near personal data.
DOMAINS = "com org net edu gov info io de fr es uk eu ch at it nl pl se no dk fi pt be ie us ca au in br jp cn".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 971 972".split()
CUES = {
    "email": "mail|contact|write|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": "card|visa|master|credit|amex|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|whatsapp|anruf|appel|llama",
}
AGAINST = "isbn|issn|doi|version|order|invoice|serial|token|hash|ticket|item|code"

_CANDIDATE = "struct<kind:int,loose:boolean,gap:int,m:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, kind: str, pattern: str, loose: bool) -> Column:
    """The matches of a pattern in order, each with the length of the text before it and what stands next to it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def row(gs: Column):
        return lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), F.length(gs[i]).alias("gap"), m.alias("m"), F.right(gs[i], F.lit(BEFORE_CHARS)).alias("before"), F.left(gs[i + 1], F.lit(1)).alias("after")
        )

    return _let(gaps, lambda gs: F.transform(found, row(gs)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.length(d)
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 1, doubled(digit(i))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _rule(kind: Column, loose: Column, m: Column, d: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = F.length(d)
    ok = F.when(kind == 0, F.lit(True)).when(kind == 1, m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")).when(kind == 2, F.when(n.between(14, 19), _luhn(d)).otherwise(False)).otherwise(n.between(10, 15))
    return ok & ~loose


def _votes(kind: Column, m: Column, d: Column, before: Column, after: Column, rule: Column) -> list[Column]:
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    of = lambda *by_kind: reduce(lambda c, k: c.when(kind == k[0], k[1]), enumerate(by_kind[1:], 1), F.when(kind == 0, by_kind[0]))
    glued = before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")
    issuer = d.rlike("^(?:4|5[1-5]|2[2-7]|3[4-8]|6011|65)")
    gazetteer = of(
        vote(F.lower(m).rlike(rf"[.\])\x20](?:{'|'.join(DOMAINS)})$"), F.lit(False)),
        vote(~m.rlike(r"^0*(?:0|127|2[4-9][0-9])\."), m.rlike(r"^0*0\.")),
        vote(issuer, ~issuer),
        vote(m.rlike(rf"^\+(?:{'|'.join(COUNTRY_CODES)})(?:[^0-9]|[0-9]{{7}})"), F.lit(False)),
    )
    context = of(*(vote(F.lower(before).rlike(CUES[k]), F.lower(before).rlike(AGAINST)) for k in KINDS))
    distinct = F.size(F.array_distinct(F.split(d, "")))
    digits = of(F.lit(0), vote(distinct >= 3, F.lit(False)), vote(distinct >= 4, distinct <= 2), vote(distinct >= 3, distinct <= 2))
    return [vote(rule, ~rule), vote(~glued, glued), gazetteer, context, digits]


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): every row with a number of its own, and the candidate spans with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_matches(F.col("text"), k, p, False) for k, p in PATTERNS), *(_matches(F.col("text"), k, p, True) for k, p in LOOSE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # numbers are fixed by writing the table
    table = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("name"), F.when(F.col("text").rlike("[0-9@]|[\\[(](?:at|AT)[\\])]"), found).otherwise(F.expr(f"cast(array() as array<{_CANDIDATE}>)")).alias("found")))
    each = table.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "c")).select("row", "at", "c.*")
    order = Window.partitionBy("row", "kind", "loose").orderBy("at")
    end = F.sum(F.col("gap") + F.length("m")).over(order)
    placed = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("m")).withColumn("d", _digits(F.col("m")))
    n = F.length("d")
    shaped = (F.col("kind") < 2) | ((F.col("kind") == 2) & n.between(13, 19)) | ((F.col("kind") == 3) & n.between(7, 15))
    kept = placed.withColumn("base", _rule(F.col("kind"), F.col("loose"), F.col("m"), F.col("d"))).where(F.col("base") | shaped)
    votes = _votes(F.col("kind"), F.col("m"), F.col("d"), F.col("before"), F.col("after"), F.col("base"))
    return table.select("row", "doc_id", "name"), cut(kept.select("row", "kind", "start", "end", "base", F.concat_ws(",", "kind", *[v.cast("string") for v in votes]).alias("code")))


def span_classifier(codes: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of each vote pattern (kind and votes, comma-joined), from how often each occurs."""
    if not codes:
        return {}
    x = np.array([list(map(int, c.split(","))) for c, _ in codes])
    kind, vote = x[:, 0], x[:, 1:] + 1
    times = np.array([n for _, n in codes], float)
    p = 1 / (1 + np.exp(-2.0 * (vote - 1).sum(axis=1)))
    for _ in range(EM_ROUNDS):
        prior = np.array([((times * p)[kind == k].sum() + 1) / (times[kind == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(prior / (1 - prior))[kind]
        for j in range(vote.shape[1]):  # reliability: how each labeler votes on spans that are and that are not
            yes = np.bincount(vote[:, j], times * p, 3) + np.array([0.5, 1, 2])
            no = np.bincount(vote[:, j], times * (1 - p), 3) + np.array([2, 1, 0.5])
            odds += np.log(yes / yes.sum() / (no / no.sum()))[vote[:, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    features = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[vote[:, j]] for j in range(vote.shape[1]))], axis=1)
    b = np.zeros(features.shape[1])
    weight = times / times.sum() * min(times.sum(), 1e4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(features @ b, -30, 30)))
        h = (features * (weight * q * (1 - q))[:, None]).T @ features + 0.1 * np.eye(len(b))
        b += np.linalg.solve(h, features.T @ (weight * (p - q)) - 0.1 * b)
    final = 1 / (1 + np.exp(-np.clip(features @ b, -30, 30)))
    return {c: float(q) for (c, _), q in zip(codes, final, strict=True)}


def _accepted(found: DataFrame) -> DataFrame:
    """The candidates that are spans of the base rule or that the classifier takes."""
    counted = [tuple(r) for r in found.groupBy("code").agg(F.count("*")).collect()]  # one row per vote pattern
    taken = sorted(c for c, p in span_classifier(counted).items() if p >= MIN_PROBABILITY)
    wanted = found.where(F.col("base") | F.col("code").isin(taken) if taken else F.col("base"))
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), "kind", "end")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    before, behind = F.max("end").over(past), F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end"))
    return wanted.withColumn("free", free).where("base or free").drop("free", "code")


def _listed(only: Column | None = None) -> Column:
    """kind:start:end of the spans by start, then kind; comma-joined."""
    one = F.struct("start", "kind", "end")
    spans = F.sort_array(F.collect_list(one if only is None else F.when(only, one)))
    name = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (of the base rule), base_sha256, spans."""
    rows, found = candidates(docs)
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    by_row = _accepted(found).groupBy("row").agg(*counts, _listed(F.col("base")).alias("base_spans"), _listed().alias("spans"))
    return rows.join(by_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; other columns stay.

    Only texts that have a candidate are shuffled, to meet their spans.
    """
    docs, restored = set_aside(docs, "doc_id", "text")
    rows, found = candidates(docs)
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = _accepted(found).withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    by_row = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("runs"))
    by_text = rows.join(by_row, "row").groupBy(F.col("doc_id").alias("_doc"), F.col("name").alias("_name")).agg(F.first("runs").alias("_runs"))
    possible = F.coalesce(F.col("text").rlike("[0-9@]|[\\[(](?:at|AT)[\\])]"), F.lit(False))
    some = docs.where(possible).join(by_text, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_name")), "left")
    kind = lambda r: F.upper(F.element_at(F.lit(list(KINDS)), r["kind"] + 1))
    stop = lambda i: F.when(i > 0, F.col("_runs")[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
    piece = lambda r, i: F.concat(F.substr("text", (stop(i) + 1).cast("int"), (r["start"] - stop(i)).cast("int")), F.lit("["), kind(r), F.lit("]"))
    rest = F.expr("substr(text, int(element_at(_runs, -1).end + 1))")
    masked = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("_runs", piece), ""), rest))
    return restored(docs.where(~possible).unionByName(some.withColumn("text", masked).select(docs.columns)))
