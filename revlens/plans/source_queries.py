"""Queries of sources, sinks and statistics, with their twins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, rendered
from ..functions import text as T
from ..operators import judgement
from ..operators import reputation as R
from ..operators import stats as S
from ..operators import store as W
from ..sources import api, dumps, lines, revision_files, wiki_api
from ..sources.tables import new_folder
from ..streaming import pages as P
from .fold_queries import streamed
from .registry import query, table


def _dump_rows(spark, sf_dir) -> DataFrame:
    """Conversations as pages of a dump; the turns of users are anonymous."""
    c = table(spark, sf_dir, "conversations")
    user = F.when(F.col("role") == "user", 0).otherwise(F.col("conv_id") % 90 + 1).cast("long")
    return c.select(
        F.col("conv_id").alias("page_id"), F.concat(F.lit("p"), "conv_id").alias("title"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id"), F.timestamp_seconds(1_600_000_000 + F.col("turn") * 3600).alias("ts"), user.alias("user_id"),
        F.when(F.col("role") != "user", F.col("role")).alias("username"), F.when(F.col("role") == "user", F.concat_ws(".", F.col("conv_id") % 256, F.lit("1.2.3"))).alias("ip"), (F.col("turn") % 3 == 0).alias("is_minor"), F.col("role").alias("comment"), F.coalesce("text", F.lit("")).alias("text"),
    )


_DUMP = """
SELECT conv_id AS page_id, 'p' || conv_id AS title, conv_id * 1000 + turn AS rev_id, 1600000000 + turn * 3600 AS time, CASE WHEN role = 'user' THEN 0 ELSE conv_id % 90 + 1 END AS user_id,
  CASE WHEN role = 'user' THEN (conv_id % 256) || '.1.2.3' ELSE role END AS username, turn % 3 = 0 AS is_minor, role AS comment, coalesce(text, '') AS text FROM conversations"""


@query(f"SELECT * EXCLUDE (text), md5(text) AS digest FROM ({_DUMP})")
def dump_round_trip(spark, sf_dir):
    """All conversations written as a compressed dump by ranges of pages, and read as a stream of revisions."""
    path = new_folder(spark, "dumps")
    dumps.write_dump(_dump_rows(spark, sf_dir), path, "gzip")
    shown = ["page_id", "title", "rev_id", F.col("time").cast("long").alias("time"), "user_id", "username", "is_minor", "comment"]
    return dumps.read_dump(spark, path).select(*shown, F.md5("text").alias("digest"))


@query("SELECT conv_id AS page_id, 'p' || conv_id AS title, count(*) AS n_broken FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id")
def broken_revisions(spark, sf_dir):
    """A dump in which every third revision is not well-formed: what the reader tells of them."""
    path = new_folder(spark, "dumps")
    dumps.write_dump(_dump_rows(spark, sf_dir), path)
    torn = F.when(F.col("value").rlike("<id>[0-9]+</id>") & F.col("value").startswith("<revision>") & (F.regexp_extract("value", "<id>([0-9]+)</id>", 1).cast("long") % 1000 % 3 == 1), F.replace("value", F.lit("</contributor>"), F.lit(""))).otherwise(F.col("value"))
    spark.read.text(path).select(torn.alias("value")).write.text(f"{path}-torn")
    told = dumps.broken(dumps.read_pieces(spark, f"{path}-torn"))
    return told.groupBy("page_id", "title").agg(F.count("*").alias("n_broken"))


@query("""
SELECT conv_id AS page_id, 't' || conv_id AS title, rev_id, CASE WHEN place % 2 = 1 THEN second ELSE first END AS continue_at, digest FROM (
  SELECT conv_id, conv_id * 1000 + turn AS rev_id, md5(coalesce(text, '')) AS digest, row_number() OVER w AS place, lead(conv_id * 1000 + turn) OVER w AS first, lead(conv_id * 1000 + turn, 2) OVER w AS second
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def paged_api(spark, sf_dir):
    """Each conversation asked for two turns at a time; the server is one row of answers for each page."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id"), F.coalesce("text", F.lit("")).alias("text"))
    # what a server would hold travels as the page's name
    served = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rev_id", "text"))).alias("revs"))
    asked = wiki_api.answers(served.select(F.to_json(F.struct("conv_id", "revs")).alias("page"), F.lit(0).alias("start")), _served, limit=2)
    return api.revisions_of_answers(asked.where("error is null"), "json").select("page_id", "title", "rev_id", "continue_at", F.md5("text").alias("digest"))


def _served(page: str, start: int, limit: int) -> str:
    held = json.loads(page)
    revs = [r for r in held["revs"] if r["rev_id"] >= start]
    told = [{"revid": r["rev_id"], "timestamp": "2020-01-01T00:00:00Z", "user": "u", "*": r["text"]} for r in revs[:limit]]
    more = {"query-continue": {"revisions": {"rvstartid": revs[limit]["rev_id"]}}} if len(revs) > limit else {}
    return json.dumps({"query": {"pages": {"1": {"pageid": held["conv_id"], "ns": 0, "title": f"t{held['conv_id']}", "revisions": told}}}, **more})


@query("""
SELECT event_type, day::TIMESTAMP AS day, count(*) AS n, min(event_id) AS first_id, sum(gap)::BIGINT AS gaps FROM (
  SELECT event_type, date_trunc('day', ts) AS day, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id)), 0) AS gap FROM events) GROUP BY event_type, day""")
def sorted_days(spark, sf_dir):
    """Events as a table of sorted days; gaps within a day read it in its order."""
    from pyspark.sql import Window

    name = f"days_{uuid.uuid4().hex}"
    days = S.write_days(table(spark, sf_dir, "events"), name, new_folder(spark, "days"), "ts", 16)
    before = F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("day").orderBy("ts", "event_id"))
    gap = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - before, F.lit(0))
    return days.withColumn("gap", gap).groupBy("event_type", F.col("day").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("gap").alias("gaps"))


@query("""
WITH m AS (SELECT l_linenumber AS bin, trunc(l_discount * 100)::INT AS col, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)
SELECT bin, col, round(weight, 2) AS weight, round(weight / sum(weight) OVER (), 8) AS of_all, round(weight / sum(weight) OVER (PARTITION BY bin), 8) AS of_bin, round(weight / sum(weight) OVER (PARTITION BY col), 8) AS of_col FROM m""")
def quality_percentages(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("bin"), (F.col("l_discount") * 100).cast("int").alias("col")).agg(F.sum("l_quantity").alias("weight"))
    return S.percentages(m).select("bin", "col", F.round("weight", 2).alias("weight"), *[F.round(c, 8).alias(c) for c in ("of_all", "of_bin", "of_col")])


@query("SELECT user_id, floor(epoch(ts))::DOUBLE AS time, (event_id % 9)::INT AS new_bin FROM events UNION ALL SELECT user_id, min(floor(epoch(ts)))::DOUBLE - 1, 0 FROM events GROUP BY user_id")
def first_bins(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("time"), (F.col("event_id") % 9).cast("int").alias("new_bin"))
    return R.with_first_bins(history)


@query("SELECT user_id, round(sum(value * (event_id % 3 - 1)), 4) AS increment FROM events GROUP BY user_id HAVING abs(sum(value * (event_id % 3 - 1))) > 40")
def increments_worth_writing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") * (F.col("event_id") % 3 - 1)).alias("increment"))
    return W.worth_writing(e, "user_id", "increment", 40.0).select("user_id", F.round("increment", 4).alias("increment"))


@query("SELECT conv_id, sum(octet_length(encode(coalesce(text, ''))) + 200)::BIGINT AS bytes, count(*) AS n FROM conversations GROUP BY conv_id")
def page_bytes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.revision_bytes(F.col("text"))).cast("long").alias("bytes"), F.count("*").alias("n"))


@query("""
SELECT doc_id, rev, md5(t) AS digest FROM (
  SELECT doc_id, 0 AS rev, CASE WHEN doc_id % 3 = 0 THEN upper(lang) || ':' || text ELSE text END AS t FROM documents
  UNION ALL SELECT doc_id + 1000000, 1, text FROM documents WHERE doc_id % 5 = 0)""")
def blob_upsert(spark, sf_dir):
    """Stored blobs, of which some are replaced and others come new."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.lit(0).alias("rev"), F.col("text").alias("blob"))
    new = docs.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit(1).alias("rev"), F.col("text").alias("blob"))
    changed = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("rev"), F.concat(F.upper("lang"), F.lit(":"), "text").alias("blob"))
    return W.upsert(stored, changed.unionByName(new), ["doc_id", "rev"], ["blob"]).select("doc_id", "rev", F.md5("blob").alias("digest"))


@query("""
SELECT event_id, previous FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS previous FROM events) WHERE value < previous""")
def unsorted_lines(spark, sf_dir):
    """Events whose value is below that of the event before, in the order of their numbers."""
    e = table(spark, sf_dir, "events").select("event_id", "value").repartitionByRange("event_id").sortWithinPartitions("event_id").withColumn("place", F.monotonically_increasing_id())
    return lines.order_breaks(e, "place", "value").select("event_id", F.col("before").alias("previous"))


@query("""
SELECT floor(epoch(ts)) AS time, event_id AS "PageId", user_id AS rev0, 'a "' || event_type AS uname0, event_id % 50 AS text, event_id % 7 AS "left", (event_id % 3)::INT AS n01, round(value, 1) AS t01 FROM events""")
def text_lines_round_trip(spark, sf_dir):
    """TextInc lines in compressed files and back."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    rows = e.select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("time"), n.alias("PageId"), F.col("user_id").alias("rev0"), n.alias("uid0"), F.concat(F.lit('a "'), "event_type").alias("uname0"), n.alias("rev1"), n.alias("uid1"), F.lit("b").alias("uname1"),
        (n % 50).cast("int").alias("text"), (n % 7).cast("int").alias("left"), (n % 3).cast("int").alias("n01"), F.round("value", 1).alias("t01"),
    )
    path = new_folder(spark, "lines")
    lines.write_statistics(rows, "TextInc", path)
    return lines.read_statistics(spark, path, "TextInc").select("time", "PageId", "rev0", "uname0", F.col("text").cast("long").alias("text"), F.col("left").cast("long").alias("left"), "n01", F.round("t01", 1).alias("t01"))


@query("""
SELECT page, event, round(sum(value) OVER w, 4) AS in_horizon, count(*) OVER w AS n_horizon FROM (
  SELECT event_type AS page, event_id AS event, ts, value, (event_id % 2)::INT AS kind FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events))
WINDOW w AS (PARTITION BY page ORDER BY ts, kind, event ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def online_horizon(spark, sf_dir):
    """Sums over the last eight events of a page, kept by a stream."""

    def summed(rows):
        return P.page_horizon(rows.select(F.col("event_type").alias("page"), F.col("event_id").alias("event"), "ts", (F.col("event_id") % 2).alias("kind"), F.col("user_id").alias("author"), "value"))

    return streamed(spark, table(spark, sf_dir, "events"), summed).select("page", "event", F.round("in_horizon", 4).alias("in_horizon"), "n_horizon")


@query(None)
def coloured_pages(spark, sf_dir):
    """Raw pages whose text stands for rendered text with marks: spans by class of trust."""
    p = table(spark, sf_dir, "pages").select("page_id", markup.visible_words("html").alias("w"))
    marked = F.array_join(F.transform("w", lambda w, i: F.when(i % 9 == 0, F.format_string("{{#t:%d,%d,u%d}}%s", i % 10, i, i % 4, w)).otherwise(w)), " ")
    return p.select("page_id", F.md5(rendered.coloured_page(marked, 6.0)).alias("digest"))


@query("SELECT conv_id AS page_id, conv_id * 1000 + turn AS rev_id, md5(coalesce(text, '')) AS digest, conv_id // 1000 AS bucket FROM conversations")
def revision_files_round_trip(spark, sf_dir):
    """Texts in folders of a thousand pages."""
    path = new_folder(spark, "texts")
    revision_files.write_revision_files(_dump_rows(spark, sf_dir), path)
    return spark.read.parquet(path).select("page_id", "rev_id", F.md5("text").alias("digest"), F.col("bucket").cast("long").alias("bucket"))


@query("SELECT DISTINCT c_name || '\"' || c_mktsegment AS name FROM customer")
def robot_list(spark, sf_dir):
    """Names as lines of a list of robots, with lines between that hold none."""
    name = F.concat("c_name", F.lit('\\"'), "c_mktsegment")
    listed = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(F.lit(' "'), name, F.lit('" ')), F.col("c_name"), F.lit('""'))).alias("value"))
    return lines.robot_names(listed)


@query("""
SELECT user_id, value FROM (
  SELECT user_id, printf('%f %d %d %d %f "%s"', 0.0, user_id, -1, trunc(ln(1 + rep))::INT, rep, coalesce(c_name, '')) AS value, rep
  FROM (SELECT user_id, arg_max(value, event_id) AS rep FROM events GROUP BY user_id) LEFT JOIN customer ON c_custkey = user_id) WHERE rep > 0""")
def reputation_lines(spark, sf_dir):
    """The last reputation of each user as lines that close a reputation file."""
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.col("event_id").alias("n"), F.col("value").alias("rep"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name"))
    told = judgement.final_reputations(history, names)
    return told.select(F.split("value", " ")[1].cast("long").alias("user_id"), "value")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN -(l_partkey % 50) ELSE l_suppkey % 11 END AS author1 FROM lineitem l
WHERE l_discount > 0 AND l_quantity > 3 AND l_shipdate BETWEEN DATE '1993-01-01' AND DATE '1997-06-30' AND CASE WHEN l_suppkey % 11 = 0 THEN -(l_partkey % 50) ELSE l_suppkey % 11 END NOT IN (0, l_partkey % 13)
  AND l_linenumber % 3 = 1 AND l_partkey % 13 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def eligible_judgements(spark, sf_dir):
    """Judgements from the revision before, by no robot; anonymous authors stand for their domain."""
    lines_ = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(0).alias("author0"), (F.col("l_suppkey") % 11).alias("author1"), (F.col("l_partkey") % 13).alias("author2"), F.col("l_discount").alias("d01"), (F.col("l_quantity") - 3).alias("delta"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_linenumber") % 3).alias("n01"), F.lit(-1).alias("domain0"), (-(F.col("l_partkey") % 50)).alias("domain1"), F.lit(None).cast("long").alias("domain2"),
    )
    robots = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("author"))
    start, end = (F.lit(d).cast("timestamp") for d in ("1993-01-01", "1997-06-30"))
    return judgement.eligible(lines_, robots, start, end, local=True, domains=True).select("l_orderkey", "l_linenumber", F.col("author1").cast("long").alias("author1"))
