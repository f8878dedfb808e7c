"""Registered queries of the engine's own operators on the driver's tables, each with its DuckDB twin.

``events`` stands for revisions (event_type = page, user_id = author, ts,
value), ``conversations`` for page histories, ``customer`` for users,
``lineitem`` for judgements (quantity = reputation, discount = quality,
price = weight).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history as H
from ..operators import judgement as J
from ..operators import reputation as R
from ..operators import stats as S
from ..operators import store as W
from ..sources import dumps as D
from ..sources import lines as L
from ..streaming import feed as E
from .registry import ORACLES, QUERIES
from .registry import query as _query
from .registry import table as _table

ORDER = ["ts", "event_id"]


@_query("""
SELECT event_type, bin, count(*) AS n FROM (
  SELECT event_type, user_id, p, CASE WHEN d IS NULL THEN 11 ELSE least(11, trunc(d / 300.0))::INT END AS bin FROM (
    SELECT event_type, user_id, lag(user_id) OVER w AS p, (floor(epoch(ts)) - floor(epoch(lag(ts) OVER w))) AS d
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)))
WHERE (p IS NULL OR p <> user_id) AND bin >= 0 GROUP BY event_type, bin""")
def intertime_histogram(spark, sf_dir):
    return H.intertime_histogram(_table(spark, sf_dir, "events"), "event_type", "user_id", "ts", ORDER)


@_query("""
SELECT event_type, event_id, user_id FROM (
  SELECT *, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
WHERE n IS NULL OR n <> user_id""")
def collapse_same_author(spark, sf_dir):
    return H.collapse_same_author(_table(spark, sf_dir, "events"), "event_type", "user_id", ORDER).select("event_type", "event_id", "user_id")


@_query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def prune_last_n(spark, sf_dir):
    return H.last_revisions(_table(spark, sf_dir, "events"), "event_type", ORDER, 50).select("event_type", "event_id")


@_query("""
SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""")
def prune_after_date(spark, sf_dir):
    recent = _table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
    return H.last_revisions(recent, "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@_query("""
SELECT conv_id, sum(new)::BIGINT AS n_revisions, sum(l)::BIGINT AS total_size, sum(l) FILTER (n <= 3)::BIGINT AS last_size FROM (
  SELECT conv_id, length(text) AS l, coalesce((lag(role) OVER w <> role)::INT, 1) AS new, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def revcount_sizes(spark, sf_dir):
    return H.revision_sizes(_table(spark, sf_dir, "conversations"), "conv_id", "role", "text", ["turn"], 3)


@_query("""
SELECT event_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id, lag(user_id) OVER w AS prev_user_id, lead(user_id) OVER w AS next_user_id
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def prev_next_revision(spark, sf_dir):
    linked = H.with_neighbours(_table(spark, sf_dir, "events"), "event_type", ORDER, ["event_id", "user_id"])
    return linked.select("event_id", "prev_event_id", "next_event_id", "prev_user_id", "next_user_id")


@_query("""
SELECT event_id, hour(ts)::INT AS hour, round(ln(1 + coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)), 0)), 6) AS log_time_before,
  round(ln(1 + abs(value - coalesce(lag(value) OVER w, 0))), 6) AS log_change, coalesce(lag(user_id) OVER w = user_id, false) AS same_author_before
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def revision_features(spark, sf_dir):
    r = H.with_neighbours(_table(spark, sf_dir, "events"), "event_type", ORDER, ["ts", "user_id", "value"])
    passed = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp("prev_ts"), F.lit(0))
    return r.select(
        "event_id",
        F.hour("ts").alias("hour"),
        F.round(F.ln(1 + passed), 6).alias("log_time_before"),
        F.round(F.ln(1 + F.abs(F.col("value") - F.coalesce("prev_value", F.lit(0.0)))), 6).alias("log_change"),
        F.coalesce(F.col("prev_user_id") == F.col("user_id"), F.lit(False)).alias("same_author_before"),
    )


@_query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY ts, event_id LIMIT 100")
def page_cursor_after(spark, sf_dir):
    at = (F.lit("2024-01-10").cast("timestamp"), F.lit(0))
    return H.cursor(_table(spark, sf_dir, "events"), at, ("ts", "event_id"), 100).select("event_id", "ts")


@_query("SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-10', 0) ORDER BY ts DESC, event_id DESC LIMIT 100")
def page_cursor_before(spark, sf_dir):
    at = (F.lit("2024-01-10").cast("timestamp"), F.lit(0))
    return H.cursor(_table(spark, sf_dir, "events"), at, ("ts", "event_id"), 100, forward=False).select("event_id", "ts")


@_query("""
SELECT p.event_id, coalesce((SELECT arg_max(h.value, (h.ts, h.value)) FROM events h WHERE h.event_type = 'purchase' AND h.user_id = p.user_id AND h.ts < p.ts), 0) AS as_of
FROM events p WHERE p.event_type <> 'purchase'""")
def asof_reputation(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    probes, history = e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'")
    return R.asof_value(probes.select("event_id", "user_id", "ts"), history, "user_id", "ts", "value", 0.0).select("event_id", "as_of")


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def robots_anti(spark, sf_dir):
    robots = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return W.without(_table(spark, sf_dir, "customer"), robots, "c_custkey").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def subset_semi(spark, sf_dir):
    wanted = _table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return W.only(_table(spark, sf_dir, "customer"), wanted, "c_custkey").select("c_custkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def purge_by_subquery(spark, sf_dir):
    gone = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return W.without(_table(spark, sf_dir, "orders"), gone, "o_orderkey").select("o_orderkey")


@_query("SELECT max(t) AS latest FROM (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem)")
def latest_union_max(spark, sf_dir):
    return W.latest(_table(spark, sf_dir, "orders").select("o_orderdate"), _table(spark, sf_dir, "lineitem").select("l_shipdate"))


@_query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def votes_dedupe(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
def queue_priority_top(spark, sf_dir):
    queue = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return queue.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@_query("""
SELECT c_custkey, round(c_acctbal + coalesce(s, 0), 2) AS reputation FROM customer
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def reputation_increment_merge(spark, sf_dir):
    added = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    users = _table(spark, sf_dir, "customer").join(added, "c_custkey", "left")
    return users.select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("s", F.lit(0.0)), 2).alias("reputation"))


@_query("SELECT trunc(ln(1 + greatest(c_acctbal, 0)))::INT AS bin, round(sum(sqrt(greatest(c_acctbal, 0))), 4) AS weight FROM customer GROUP BY 1")
def rep_histogram_load(spark, sf_dir):
    return R.reputation_histogram(_table(spark, sf_dir, "customer"), "c_acctbal").select("bin", F.round("weight", 4).alias("weight"))


@_query("""
WITH h AS (SELECT trunc(ln(1 + greatest(c_acctbal, 0)))::INT AS bin, sum(sqrt(greatest(c_acctbal, 0))) AS weight FROM customer GROUP BY 1),
c AS (SELECT bin, weight, sum(weight) OVER (ORDER BY bin) AS upto, sum(weight) OVER () AS total FROM h)
SELECT round(bin + (0.9 * total - (upto - weight)) / weight, 6) AS median FROM c WHERE upto >= 0.9 * total ORDER BY bin LIMIT 1""")
def hi_median(spark, sf_dir):
    return R.high_median(R.reputation_histogram(_table(spark, sf_dir, "customer"), "c_acctbal"), 0.9).select(F.round("median", 6).alias("median"))


_MATRIX = "SELECT trunc(ln(1 + l_quantity))::INT AS bin, trunc((1 - (1 - 20 * l_discount)) / 0.2)::INT AS col, sum(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2"


def _matrix(spark, sf_dir):
    return S.quality_matrix(_table(spark, sf_dir, "lineitem"), R.reputation_bin(F.col("l_quantity")), 1 - 20 * F.col("l_discount"), F.col("l_extendedprice"))


@_query(f"SELECT bin, col, round(weight, 2) AS weight FROM ({_MATRIX})")
def quality_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).withColumn("weight", F.round("weight", 2))


@_query(f"SELECT bin, col, round(sum(weight) OVER (PARTITION BY bin ORDER BY col DESC) / sum(weight) OVER (PARTITION BY bin), 8) AS share FROM ({_MATRIX})")
def quality_matrix_cumulative(spark, sf_dir):
    return S.cumulative(_matrix(spark, sf_dir)).withColumn("share", F.round("share", 8))


@_query(f"""
SELECT round(hit / low, 8) AS precision, round(hit / bad, 8) AS recall, round(hit * a / (low * bad), 8) AS boost FROM (
  SELECT sum(weight) FILTER (bin < 2 AND col >= 7) AS hit, sum(weight) FILTER (bin < 2) AS low, sum(weight) FILTER (col >= 7) AS bad, sum(weight) AS a FROM ({_MATRIX}))""")
def precision_recall_mi(spark, sf_dir):
    return S.precision_recall(_matrix(spark, sf_dir), 2, 7).select(*[F.round(c, 8).alias(c) for c in ("precision", "recall", "boost")])


def _plogp(p: str, against: str = "1") -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ({against})) ELSE 0 END"


@_query(f"""
WITH w AS (
  SELECT coalesce(sum(weight) FILTER (bin < 2 AND col >= 7), 0) / sum(weight) AS bl, coalesce(sum(weight) FILTER (bin >= 2 AND col >= 7), 0) / sum(weight) AS bh,
    coalesce(sum(weight) FILTER (bin < 2 AND col < 7), 0) / sum(weight) AS gl, coalesce(sum(weight) FILTER (bin >= 2 AND col < 7), 0) / sum(weight) AS gh FROM ({_MATRIX})),
p AS (SELECT *, bl + bh AS bad, gl + gh AS good, bl + gl AS low, bh + gh AS high FROM w),
i AS (SELECT {" + ".join(_plogp(a + b, f"{x} * {y}") for a, x in (("b", "bad"), ("g", "good")) for b, y in (("l", "low"), ("h", "high")))} AS mi,
  -({_plogp("bad")} + {_plogp("good")}) AS e_bad, -({_plogp("low")} + {_plogp("high")}) AS e_low FROM p)
SELECT round(mi, 8) AS mutual_information, round(e_bad, 8) AS entropy_bad, round(e_low, 8) AS entropy_low, round(mi / nullif(e_low, 0), 8) AS constraint_coefficient FROM i""")
def reputation_information(spark, sf_dir):
    told = S.information(_matrix(spark, sf_dir), 2, 7)
    return told.select(*[F.round(c, 8).alias(c) for c in told.columns])


@_query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def monthly_stats(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1, 2")
def bucket_by_day(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@_query("""
SELECT l_orderkey, count(*) AS n_judges, round(sum(l_quantity), 4) AS judge_weight, round(sum((1 - 20 * l_discount) * l_quantity), 4) AS total_quality, round(min(1 - 20 * l_discount), 6) AS min_quality
FROM lineitem GROUP BY 1""")
def judgement_agg(spark, sf_dir):
    j = S.judgements(_table(spark, sf_dir, "lineitem"), "l_orderkey", 1 - 20 * F.col("l_discount"), F.col("l_quantity"))
    return j.select("l_orderkey", "n_judges", F.round("judge_weight", 4).alias("judge_weight"), F.round("total_quality", 4).alias("total_quality"), F.round("min_quality", 6).alias("min_quality"))


@_query("SELECT least(9, greatest(0, trunc(l_quantity / 6 + 0.5)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def trust_histogram(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(T.trust_bin(F.col("l_quantity") / 6).alias("bin")).agg(F.count("*").alias("n"))


@_query("""
SELECT l_orderkey, round(sum(b)::DOUBLE * exp(-0.05 * sum(1 / pow(2.0, b))), 6) AS overall FROM (
  SELECT l_orderkey, least(9, greatest(0, trunc(l_quantity / 6 + 0.5)))::INT AS b FROM lineitem) GROUP BY 1""")
def overall_trust(spark, sf_dir):
    binned = _table(spark, sf_dir, "lineitem").select("l_orderkey", T.trust_bin(F.col("l_quantity") / 6).alias("b"))
    h = binned.groupBy("l_orderkey").agg(F.array(*[F.count(F.when(F.col("b") == i, 1)) for i in range(10)]).alias("h"))
    return h.select("l_orderkey", F.round(T.overall_trust(F.col("h")), 6).alias("overall"))


@_query("""
SELECT event_id, round(1 - exp(-(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w))) / 86400.0), 8) AS factor
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def time_factor(spark, sf_dir):
    e = H.with_neighbours(_table(spark, sf_dir, "events"), "event_type", ORDER, ["ts"])
    return e.select("event_id", F.round(1 - F.exp(-(F.unix_timestamp("ts") - F.unix_timestamp("prev_ts")) / 86400.0), 8).alias("factor"))


def _newton(steps: int) -> str:
    sql = "SELECT l_orderkey, l_linenumber, l_quantity AS l, (1 + l_linenumber)::DOUBLE AS n, 50.0::DOUBLE AS t, 0.0::DOUBLE AS a FROM lineitem"
    for _ in range(steps):
        sql = f"SELECT l_orderkey, l_linenumber, l, n, t, a - ((1 - a) * l - a * t * (1 - pow(a, n))) / (-l - t + t * (n + 1) * pow(a, n)) AS a FROM ({sql})"
    return f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l = 0 THEN 0 ELSE a END, 8) AS decay FROM ({sql})"


@_query(_newton(5))
def text_decay_newton(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    decay = T.text_decay(F.col("l_quantity"), (1 + F.col("l_linenumber")).cast("double"), F.lit(50.0))
    return rows.select("l_orderkey", "l_linenumber", F.round(decay, 8).alias("decay"))


@_query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 1 ELSE least(1, (l_tax - l_quantity / 1000) / l_discount) END, 8) AS quality FROM lineitem""")
def quality_variants(spark, sf_dir):
    q = R.specific_quality(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 1000)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(q, 8).alias("quality"))


@_query("""
SELECT c_custkey, sig, (sig & 1023)::BIGINT AS a, ((sig >> 10) & 1023)::BIGINT AS b, ((sig >> 20) & 1023)::BIGINT AS c FROM (
  SELECT c_custkey, ((c_custkey % 1024) | ((c_custkey * 7 % 1024) << 10) | ((c_custkey * 13 % 1024) << 20))::BIGINT AS sig FROM customer)""")
def sig_pack_unpack(spark, sf_dir):
    k = F.col("c_custkey")
    packed = _table(spark, sf_dir, "customer").select("c_custkey", T.pack_signature(k % 1024, k * 7 % 1024, k * 13 % 1024).alias("sig"))
    return packed.select("*", *[T.unpack_signature(F.col("sig"), i).alias(n) for i, n in enumerate("abc")])


@_query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&apos;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS digest FROM pages")
def xml_disarm(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_disarm(F.col("html"))).alias("digest"))


@_query(r"SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?--[ \n\t]*>', '', 'g')) AS digest FROM pages")
def strip_comments(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_comments(F.col("html"))).alias("digest"))


_WORD = "SELECT * FROM (SELECT doc_id, unnest(string_split_regex(text, '[,;.: \\n\\t]+')) AS w FROM documents) WHERE w <> ''"
_CANONICAL = f"SELECT doc_id, translate(regexp_replace(w, '[.:;,]$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM ({_WORD})"


def _words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.canonical_words(F.col("text"))).alias("word"))


@_query(f"SELECT word, count(*) AS n FROM ({_CANONICAL}) GROUP BY word")
def word_frequency(spark, sf_dir):
    return S.word_frequency(_words(spark, sf_dir))


@_query(f"SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM ({_CANONICAL}) GROUP BY doc_id")
def canonical_words(spark, sf_dir):
    # the array functions count within the row: no exchange
    lower = T.canonical_words(F.col("text"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", lower.alias("w")).where(F.size("w") > 0)
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@_query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, floor(epoch(ts))::BIGINT AS seconds FROM events")
def time_conversions(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("compact"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_timestamp("ts").alias("seconds"))


@_query("SELECT event_id, -((user_id % 256) * 65536 + (event_id % 256) * 256 + 7)::BIGINT AS domain_id FROM events")
def ip_domain_id(spark, sf_dir):
    ip = F.concat_ws(".", F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7"), F.lit("9"))
    return _table(spark, sf_dir, "events").select("event_id", T.ip_domain_id(ip, 3).alias("domain_id"))


@_query("SELECT l_orderkey, l_linenumber, trunc(least(9, greatest(0, (l_quantity / 6 + 0.5) * 10 / 7.5)))::INT AS class FROM lineitem")
def trust_css_class(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.trust_css_class(F.col("l_quantity") / 6, F.lit(7.5)).alias("class"))


@_query("""
SELECT doc_id, rev_id, text FROM (
  SELECT doc_id, unnest([1, 2]) AS rev_id, unnest([substr(text, 1, length(text) // 3), substr(text, length(text) // 3 + 1)]) AS text FROM documents WHERE text IS NOT NULL)""")
def blob_round_trip(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    third = F.floor(F.length("text") / 3).cast("int")
    parts = F.array(F.struct(F.lit(1).alias("r"), F.substring("text", F.lit(1), third).alias("t")), F.struct(F.lit(2).alias("r"), F.substring("text", third + 1, F.length("text")).alias("t")))
    revs = docs.select("doc_id", F.inline(parts))
    return L.revisions_of_blob(L.blob_of_revisions(revs, "doc_id", "r", "t"), "doc_id", "blob")


@_query("""
SELECT doc_id // 1000 AS page_id, 2 * doc_id + half AS rev_id, CASE half WHEN 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS text
FROM documents, (SELECT unnest([0, 1]) AS half) WHERE text IS NOT NULL""")
def blob_packing(spark, sf_dir):
    # both halves of each document as revisions of a page of a thousand documents: pages of several blobs
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    middle = F.floor(F.length("text") / 2).cast("int")
    halves = [F.struct((2 * F.col("doc_id") + i).alias("r"), t.alias("t")) for i, t in enumerate((F.substring("text", F.lit(1), middle), F.substring("text", middle + 1, F.length("text"))))]
    revs = docs.select(F.expr("doc_id div 1000").alias("page_id"), F.inline(F.array(*halves)))
    blobs = L.blob_of_revisions(L.packed(revs, "page_id", "r", "t"), ["page_id", "blob_id"], "r", "t")
    return L.revisions_of_blob(blobs, "page_id", "blob")


@_query("""
SELECT floor(epoch(ts)) AS time, event_id AS rev0, user_id AS uid0, 'u"' || event_type AS uname0, (event_id % 7)::INT AS "NJudges", round(value, 2) AS delta FROM events""")
def statistics_round_trip(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    rows = e.select(
        F.unix_timestamp("ts").cast("double").alias("time"), F.col("event_id").alias("PageId"), F.col("event_id").alias("rev0"), F.col("user_id").alias("uid0"),
        F.concat(F.lit('u"'), "event_type").alias("uname0"), (F.col("event_id") % 7).cast("int").alias("NJudges"), F.round("value", 2).alias("Delta"), F.lit(0.5).alias("AvgSpecQ"),
    )
    back = L.parse_statistics(L.statistics_lines(rows, "EditLife"), "EditLife")
    return back.select("time", "rev0", "uid0", "uname0", "NJudges", F.round("Delta", 2).alias("delta"))


@_query("""
SELECT event_id, user_id, bin FROM (SELECT event_id, user_id, trunc(ln(1 + greatest(value, 0)))::INT AS bin FROM events)""")
def reputation_history_round_trip(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").select(F.format_string('%d %d 0 %d %f "a b"', "event_id", "user_id", R.reputation_bin(F.col("value")), "value").alias("value"))
    return L.parse_reputations(lines).select(F.col("time").cast("long").alias("event_id"), "user_id", F.col("new_bin").alias("bin"))


@_query("SELECT c_custkey, c_name AS robot FROM customer")
def robots_of_markup(spark, sf_dir):
    listed = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("x {{BotS|"), "c_name", F.lit("|12|a}}")).alias("text"))
    return L.robots_of_markup(listed, "text").select("c_custkey", "robot")


@_query("""
SELECT user_id, event_id, kind_rank, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind_rank, event_id) AS place
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS kind_rank FROM events)""")
def event_feed_merge(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    feed = E.merged(e.where("event_type <> 'click'"), e.where("event_type = 'click'"))
    return E.feed_order(feed, "user_id", "ts", "event_id").select("user_id", "event_id", "kind_rank", "place")


@_query("SELECT event_type, date_trunc('day', ts) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def time_buckets(spark, sf_dir):
    return E.time_buckets(_table(spark, sf_dir, "events"), "event_type", "ts")


@_query("""
SELECT event_id, round(sum(value) OVER w, 4) AS in_horizon, count(*) OVER w AS n_horizon FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def revision_horizon(spark, sf_dir):
    kept = E.horizon(_table(spark, sf_dir, "events"), "user_id", ORDER, "value")
    return kept.select("event_id", F.round("in_horizon", 4).alias("in_horizon"), "n_horizon")


@_query("""
SELECT conv_id, count(*) AS n_turns, chunk FROM conversations
JOIN (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 10 AS chunk FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)
GROUP BY conv_id, chunk""")
def page_chunks(spark, sf_dir):
    return D.chunked(_table(spark, sf_dir, "conversations"), "conv_id", 10).groupBy("conv_id", "chunk").agg(F.count("*").alias("n_turns"))


@_query("""
SELECT user_id, event_id FROM events WHERE event_id % 3 = 0
UNION ALL SELECT e.user_id, e.event_id FROM events e
JOIN (SELECT user_id, max(ts) AS upto FROM events WHERE event_id % 3 = 0 GROUP BY user_id) USING (user_id) WHERE event_id % 3 <> 0 AND ts > upto""")
def dump_with_updates(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return D.with_updates(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "user_id", "ts").select("user_id", "event_id")


@_query("""
SELECT l_orderkey, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS closest, min(l_quantity) AS distance FROM lineitem GROUP BY l_orderkey""")
def closest_revision(spark, sf_dir):
    return H.closest(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber")


@_query("""
SELECT event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM (SELECT DISTINCT event_type, event_id, ts FROM events WHERE value > 1 OR event_id % 2 = 0)) WHERE n <= 20""")
def merge_revision_lists(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    both = H.merged_lists(e.where("value > 1").drop("value"), e.where("event_id % 2 = 0").drop("value"), ["event_type", "event_id", "ts"])
    return H.last_revisions(both, "event_type", ORDER, 20)


@_query("""
SELECT slot, round(sum(w), 4) AS work FROM (
  SELECT least(9, greatest(0, trunc(ln(1.2 + l_quantity))))::INT AS slot, l_extendedprice AS w FROM lineitem) GROUP BY slot""")
def work_histogram(spark, sf_dir):
    return R.work_histogram(_table(spark, sf_dir, "lineitem"), F.ln(1.2 + F.col("l_quantity")), F.col("l_extendedprice")).select("slot", F.round("work", 4).alias("work"))


_JUDGED_LINES = """
SELECT l_orderkey, l_extendedprice % 40 AS d01, l_quantity AS d02, (l_partkey % 60)::DOUBLE AS d12, (l_linenumber % 6)::BIGINT AS n01, (l_suppkey % 6)::BIGINT AS n12, (l_partkey % 90000)::DOUBLE AS t01, (l_suppkey * 997 % 120000)::DOUBLE AS t12,
  (l_partkey % 7)::DOUBLE AS rep0, (l_suppkey % 5)::DOUBLE AS rep1, (l_linenumber % 7)::DOUBLE AS rep2 FROM lineitem"""


@_query(f"""
SELECT count(*) AS n_revisions, count(*) FILTER (nixed) AS n_nixed, round(count(*) FILTER (nixed) / count(*), 8) AS ratio FROM (
  SELECT l_orderkey, bool_or((CASE WHEN d01 > 0 THEN d02 < d12 ELSE false END AND t12 <= 86400 AND rep2 > rep1 AND rep0 > rep1) OR (n01 + n12 >= 10 AND t01 + t12 <= 86400)) AS nixed FROM ({_JUDGED_LINES}) GROUP BY l_orderkey)""")
def nixed_ratio(spark, sf_dir):
    as_double = lambda c: c.cast("double")
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", as_double(F.col("l_extendedprice") % 40).alias("d01"), as_double(F.col("l_quantity")).alias("d02"), as_double(F.col("l_partkey") % 60).alias("d12"), (F.col("l_linenumber") % 6).alias("n01"), (F.col("l_suppkey") % 6).alias("n12"),
        as_double(F.col("l_partkey") % 90000).alias("t01"), as_double(F.col("l_suppkey") * 997 % 120000).alias("t12"), as_double(F.col("l_partkey") % 7).alias("rep0"), as_double(F.col("l_suppkey") % 5).alias("rep1"), as_double(F.col("l_linenumber") % 7).alias("rep2"),
    )
    n = R.nixed_ratio(lines, "l_orderkey", J.nixes(J.Rules()))
    return n.select("n_revisions", "n_nixed", F.round("ratio", 8).alias("ratio"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import edit_queries, fold_queries, model_queries, source_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
