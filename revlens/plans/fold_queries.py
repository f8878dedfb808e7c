"""Queries over whole page histories: ``conversations`` are pages, their turns revisions an hour apart, roles authors.

SQL cannot express most of them; tests hold their operators against known
values and plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as T
from ..operators import diff, history, judgement, tracking
from ..operators import reputation as R
from ..operators import stats as S
from ..sources import api, dumps, revision_files
from ..sources.tables import in_order, new_folder
from ..streaming import pages as P
from .registry import query, table

HORIZON = 3
ORDER = ["revision"]


def _revisions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    author = F.when(F.col("role") == "user", F.col("conv_id") % 50 + 1).when(F.col("role") == "assistant", F.lit(100)).otherwise(0)
    # a turn's text follows the turn before, as a revision keeps most of its page
    text = F.concat_ws(" ", F.lag("text").over(_turns()), F.coalesce("text", F.lit("")))
    return c.select(F.col("conv_id").alias("page"), (F.col("conv_id") * 1000 + F.col("turn")).alias("revision"), author.alias("author"), F.timestamp_seconds(1_600_000_000 + F.col("turn") * 3600).alias("ts"), F.ln(1.2 + F.col("conv_id") % 7).alias("weight"), diff.words_of(text).alias("words"))


def _turns():
    return Window.partitionBy("conv_id").orderBy("turn")


def _distances(revs: DataFrame, horizon: int = 2 * HORIZON) -> DataFrame:
    return diff.page_distances(revs, ORDER, horizon)


@query(None)
def edit_distance_turns(spark, sf_dir):
    return _distances(_revisions(spark, sf_dir)).select("page", "a", "b", F.round("distance", 6).alias("distance"))


@query(None)
def composed_distances(spark, sf_dir):
    """Distances to older texts by way of the texts between, where these cover enough."""
    told = diff.page_distances(_revisions(spark, sf_dir), ORDER, 2 * HORIZON, diff.Shortcut(), lists=True)
    words = lambda kind: F.aggregate(F.filter("edits", lambda e: e["kind"] == kind), F.lit(0), lambda s, e: s + e["l"])
    return told.select("page", "a", "b", F.round("distance", 6).alias("distance"), words("mov").alias("moved"), words("del").alias("deleted"), words("ins").alias("inserted"))


@query(None)
def reverted_revisions(spark, sf_dir):
    revs = _revisions(spark, sf_dir)
    d = _distances(revs).select("page", F.col("b").alias("right"), F.col("a").alias("left"), "distance")
    return diff.reverted(d)


@query(None)
def word_origins(spark, sf_dir):
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER)
    sums = [F.aggregate("lived", F.lit(0), lambda a, x: a + x).alias("lived"), F.round(F.aggregate("trust", F.lit(0.0), lambda a, x: a + x), 6).alias("trust")]
    return told.select("page", "revision", "author", "n_new", "n_back", F.size("words").alias("n_words"), F.size(F.array_distinct("origin")).alias("n_origins"), *sums)


@query(None)
def signed_trust(spark, sf_dir):
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER, tracking.Trust(kind="signed"))
    sums = [F.round(F.aggregate("trust", F.lit(0.0), lambda a, x: a + x), 6).alias("trust"), F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("signatures")]
    return told.select("page", "revision", F.size("words").alias("n_words"), *sums)


@query(None)
def author_words(spark, sf_dir):
    return tracking.words_by_author(tracking.track_words(_revisions(spark, sf_dir), ORDER))


@query(None)
def contribution(spark, sf_dir):
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER)
    return tracking.contribution(told, ORDER, F.timestamp_seconds(F.lit(1_600_100_000))).select("author", F.round("word_days", 6).alias("word_days"))


@query(None)
def text_lives(spark, sf_dir):
    return judgement.text_lives(tracking.track_words(_runs(spark, sf_dir), ORDER), ORDER, HORIZON)


@query(None)
def text_inc_rows(spark, sf_dir):
    told = judgement.text_judgements(tracking.track_words(_runs(spark, sf_dir), ORDER), ORDER, HORIZON)
    return told.select("page", "revision0", "author0", "revision1", "author1", "text", "left", "n01", "t01")


@query(None)
def coloured_text(spark, sf_dir):
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER)
    return tracking.coloured(told).select("page", "revision", F.md5("text").alias("digest"))


def _marked_up(spark, sf_dir) -> DataFrame:
    """Conversations as revisions in markup: each turn a section below the turn before."""
    revs = _revisions(spark, sf_dir).drop("words")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), (F.col("conv_id") * 1000 + F.col("turn")).alias("revision"), F.concat(F.lit("== "), "role", F.lit(" ==\n* "), F.coalesce("text", F.lit(""))).alias("part"))
    parts = F.array_join(F.collect_list("part").over(Window.partitionBy("page").orderBy("revision").rowsBetween(-2, 0)), "\n")
    return revs.join(c.select("page", "revision", parts.alias("text")), ["page", "revision"]).withColumn("words", markup.visible_words("text"))


@query(None)
def coloured_markup(spark, sf_dir):
    """Tracked revisions as markup with marks of trust, origin and author among its separators."""
    told = tracking.track_words(_marked_up(spark, sf_dir), ORDER, tracking.Trust(kind="signed", recents=4))
    return told.select("page", "revision", F.md5(markup.coloured_markup("text", "trust", "origin", "writer")).alias("digest"))


@query(None)
def coloured_dump(spark, sf_dir):
    """The last two coloured revisions of each page, written as a dump and read again."""
    told = tracking.track_words(_marked_up(spark, sf_dir), ORDER, tracking.Trust(kind="signed", recents=4))
    rows = told.select(F.col("page").alias("page_id"), F.concat(F.lit("p"), "page").alias("title"), F.col("revision").alias("rev_id"), "ts", F.col("author").alias("user_id"), F.concat(F.lit("u"), "author").alias("username"), F.lit(None).cast("string").alias("ip"), F.lit(False).alias("is_minor"), F.lit("").alias("comment"), markup.coloured_markup("text", "trust", "origin", "writer").alias("text"))
    path = new_folder(spark, "dumps")
    dumps.write_dump(revision_files.last_coloured(rows, ["ts", "rev_id"], 2), path, "gzip")
    return dumps.read_dump(spark, path).select("page_id", "rev_id", "user_id", F.md5("text").alias("digest"))


def _runs(spark, sf_dir) -> DataFrame:
    """Of each run of one author's revisions the last."""
    return history.collapse_same_author(_revisions(spark, sf_dir), "page", "author", ORDER)


def _judged(spark, sf_dir) -> DataFrame:
    revs = _runs(spark, sf_dir)
    return judgement.judgements(revs, _distances(revs), ORDER, HORIZON)


@query(None)
def edit_inc_rows(spark, sf_dir):
    return _judged(spark, sf_dir).select("page", "revision0", "revision1", "revision2", *[F.round(c, 6).alias(c) for c in ("delta", "d01", "d02", "d12", "dp2")], "n01", "n12", "t01", "t12")


@query(None)
def edit_lives(spark, sf_dir):
    return judgement.edit_lives(_judged(spark, sf_dir)).withColumn("avg_quality", F.round("avg_quality", 6))


@query(None)
def closest_judgements(spark, sf_dir):
    told = judgement.closest_judgements(_judged(spark, sf_dir), F.ln(1.2 + F.col("author2") % 5))
    return told.select("page", "revision1", "revision2", "closest", F.round("quality", 6).alias("quality"), F.round("judge_weight", 6).alias("judge_weight"), F.round("delta", 6).alias("delta"))


@query(None)
def reputation_fold(spark, sf_dir):
    robots = spark.createDataFrame([(999,)], "author long")
    judged = judgement.eligible(_judged(spark, sf_dir), robots, F.lit("2000-01-01").cast("timestamp"), F.lit("2030-01-01").cast("timestamp"))
    numbered = in_order(judged, "number", "ts", "page", "revision2", "revision1", "revision0")
    return judgement.reputations(numbered, "number").select("author", "n", F.round("rep", 6).alias("rep"))


@query(None)
def on_line_reputation_fold(spark, sf_dir):
    revs = _revisions(spark, sf_dir)
    judged = judgement.on_line_judgements(revs, _distances(revs, judgement.OnLine().consider - 1), ORDER, spark.createDataFrame([(999,)], "author long"))
    told = judgement.on_line_reputations(judged)
    return told.select("author", "revision1", "revision2", F.round("rep", 6).alias("rep"))


# --- markup --------------------------------------------------------------------


@query(None)
def markup_words(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", markup.wiki_words(F.col("html"), most=None).alias("pieces"))
    return pages.select("page_id", F.size("pieces").alias("n_pieces"), F.size(markup.words_only(F.col("pieces"))).alias("n_words"), F.md5(F.array_join(markup.words_only(F.col("pieces")), "\x01")).alias("digest"))


@query("""
SELECT doc_id, len(w) AS n_words, md5(array_to_string(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ')) AS digest FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z0-9,;.: ]', 'x', 'g'), '[,;.: ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)""")
def plain_markup_words(spark, sf_dir):
    # without markup the words are those of a plain split; a first blank or colon would be that of a line
    docs = table(spark, sf_dir, "documents").where("text is not null")
    plain = F.ltrim(F.regexp_replace("text", "[^A-Za-z0-9,;.: ]", "x"), F.lit(",;.: "))
    words = markup.visible_words(plain, disarm=False)
    visible = docs.select("doc_id", F.filter(words, lambda w: w != "").alias("w"))
    return visible.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(None)
def markup_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", markup.wiki_words(F.col("html"), most=None).alias("pieces"))
    return markup.sections(pages, "page_id").groupBy("page_id", "section").agg(F.count("*").alias("n_words"))


@query(None)
def marked_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", markup.wiki_words(F.col("html"), most=None).alias("pieces"))
    return pages.select("page_id", F.md5(markup.marked_text(F.col("pieces"))).alias("digest"))


# --- feeds and statistics --------------------------------------------------------


@query("""
SELECT page, event, place, lag(event) OVER w AS previous, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts, kind, event) AS place FROM (
    SELECT event_type AS page, event_id AS event, ts, (event_id % 2)::INT AS kind FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)))
WINDOW w AS (PARTITION BY page ORDER BY place)""")
def online_page_feed(spark, sf_dir):
    """The feed as a stream over files of the table, until the watermark at its end; what it wrote."""

    def fed(rows):
        return P.page_feed(rows.select(F.col("event_type").alias("page"), F.col("event_id").alias("event"), "ts", (F.col("event_id") % 2).alias("kind"), F.col("user_id").alias("author")))

    return streamed(spark, table(spark, sf_dir, "events"), fed).select("page", "event", "place", "previous", "kind")


@query(None)
def online_page_trust(spark, sf_dir):
    """Conversations as a stream of revisions, every fifth a vote; sums of what the page update wrote."""
    c = table(spark, sf_dir, "conversations")
    revs = _revisions(spark, sf_dir).select(F.col("page").cast("string").alias("page"), F.col("revision").alias("event"), "ts", F.when(F.col("revision") % 5 == 4, 1).otherwise(0).alias("kind"), "author", "weight", "words")
    # a last event moves the watermark beyond all others
    last = c.limit(1).select(F.lit("-").alias("page"), F.lit(0).cast("long").alias("event"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.lit(0).alias("kind"), F.lit(0).alias("author"), F.lit(0.0).alias("weight"), F.array().cast("array<string>").alias("words"))
    told = streamed(spark, revs.unionByName(last), lambda rows: P.page_trust(rows, tracking.Trust(kind="signed", recents=4)))
    return told.select(F.col("page").cast("long").alias("page"), "revision", F.size("words").alias("n_words"), F.round(F.aggregate("trust", F.lit(0.0), lambda a, x: a + x), 6).alias("trust"))


def streamed(spark, rows: DataFrame, step) -> DataFrame:
    """What ``step`` makes of ``rows`` as a stream of files, run until no more is due."""
    folder = new_folder(spark, "streams")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, P.ROCKSDB)
    try:
        rows.write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = step(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out")


@query(None)
def revert_aware_trust(spark, sf_dir):
    """Words of a text that was taken back have the origin and at least the trust that they had there."""
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER, tracking.Trust(kind="signed", recents=4))
    sums = [F.round(F.aggregate("trust", F.lit(0.0), lambda a, x: a + x), 6).alias("trust"), F.aggregate("origin", F.lit(0).cast("long"), lambda a, x: a + x).alias("origins")]
    return told.select("page", "revision", "n_new", F.size("words").alias("n_words"), *sums)


def _trust_sums(told: DataFrame) -> DataFrame:
    return told.select("page", "revision", F.size("words").alias("n_words"), F.round(F.aggregate("trust", F.lit(0.0), lambda a, x: a + x), 6).alias("trust"))


@query(None)
def local_trust(spark, sf_dir):
    """Trust by sections, with shares read in proportion to the time passed, and deleted blocks kept as batch runs do."""
    rule = tracking.Trust.batch(kind="sections")
    return _trust_sums(tracking.track_words(tracking.timed_reads(_revisions(spark, sf_dir), ORDER, rule, on_line=False), ORDER, rule))


@query(None)
def for_online_trust(spark, sf_dir):
    """A batch run that prepares pages for the on-line one: signed and revert-aware trust with timed reading, percolated."""
    rule = tracking.Trust.batch(kind="signed", recents=4, percolates=True)
    return _trust_sums(tracking.track_words(tracking.timed_reads(_revisions(spark, sf_dir), ORDER, rule), ORDER, rule))


@query(None)
def percolated_histograms(spark, sf_dir):
    """Words by trust of every revision, once later revisions of its page have raised it."""
    told = tracking.track_words(_revisions(spark, sf_dir), ORDER, tracking.Trust(kind="signed", recents=4, percolates=True))
    return told.select("page", "revision", T.trust_histogram(F.col("trust")).alias("h")).select("page", "revision", *[F.col("h")[i].alias(f"h{i}") for i in range(10)])


@query("""
SELECT page, revision, kind FROM (
  SELECT page, revision, 'trust' AS kind FROM (SELECT l_orderkey AS page, l_linenumber AS revision, l_discount AS trust FROM lineitem) QUALIFY row_number() OVER (PARTITION BY page ORDER BY trust DESC, revision DESC) <= 2
  UNION ALL SELECT page, revision, 'reputation' FROM (
    SELECT l_orderkey AS page, l_linenumber AS revision, l_suppkey AS author FROM lineitem WHERE l_quantity > 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC) = 1)
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY revision DESC) <= 2)""")
def remembered_revisions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("revision"), F.col("l_suppkey").alias("author"), F.col("l_discount").alias("trust"), F.col("l_quantity").alias("reputation"))
    return R.remembered(lines, ["revision"], least=20.0)


@query("""
WITH e AS (
  SELECT 'edit' AS kind, l_shipdate AS time, l_extendedprice * l_linenumber AS weight, greatest(-1, least(1, 1 - 30 * l_discount)) AS quality FROM lineitem WHERE l_suppkey % 9 > 0
  UNION ALL SELECT 'text', l_shipdate, l_quantity, greatest(-1, least(1, l_tax * 20)) FROM lineitem WHERE l_suppkey % 9 > 0),
m AS (SELECT kind, date_trunc('month', time)::TIMESTAMP AS month, count(*) AS n, sum(weight) AS w, sum(weight * quality) AS p FROM e GROUP BY ALL)
SELECT kind, month, sum(n) OVER o::BIGINT AS n, round(sum(w) OVER o, 2) AS weight, round(sum(p) OVER o / sum(w) OVER o, 8) AS quality FROM m WINDOW o AS (PARTITION BY kind ORDER BY month)""")
def quality_by_month(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("author", F.col("l_suppkey") % 9).withColumn("time", F.col("l_shipdate")).withColumn("rep", F.col("l_quantity"))
    edits = lines.select("time", "author", "rep", F.col("l_extendedprice").alias("delta"), F.col("l_linenumber").alias("n_judges"), (1 - 30 * F.col("l_discount")).alias("avg_quality"))
    texts = lines.select("time", "author", "rep", F.col("l_quantity").alias("new_text"), (F.col("l_tax") * 20).alias("decay"))
    months = S.by_month(S.quality_events(edits, texts), total=True)
    return months.select("kind", F.col("month").cast("timestamp_ntz").alias("month"), "n", F.round("weight", 2).alias("weight"), F.round("quality", 8).alias("quality"))


@query("SELECT c_custkey, round(ln(1.2 + greatest(c_acctbal, 0)), 8) AS on_line, round(ln(1 + CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE greatest(c_acctbal, 0) END), 8) AS batch FROM customer")
def reputation_weights(spark, sf_dir):
    rep = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(R.weight_of(rep), 8).alias("on_line"), F.round(R.weight_of(F.when(F.col("c_custkey") % 3 != 0, rep), False), 8).alias("batch"))


@query("""
SELECT conv_id AS page_id, 't' || conv_id AS title, conv_id * 1000 + turn AS rev_id, role AS username, role = 'user' AS is_anonymous, md5(text) AS digest, (conv_id * 1000 + turn + 1)::BIGINT AS continue_at
FROM conversations WHERE conv_id % 5 > 0 AND text IS NOT NULL""")
def api_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    anon = F.when(F.col("role") == "user", "")
    revision = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("revid"), F.lit("2020-01-01T00:00:00Z").alias("timestamp"), F.col("role").alias("user"), anon.alias("anon"), F.col("text").alias("*"))
    page = F.struct(F.col("conv_id").alias("pageid"), F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0).alias("ns"), F.concat(F.lit("t"), "conv_id").alias("title"), F.array(revision).alias("revisions"))
    answer = F.struct(F.struct(F.create_map(F.col("conv_id").cast("string"), page).alias("pages")).alias("query"), F.struct(F.struct((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("rvstartid")).alias("revisions")).alias("query-continue"))
    told = api.revisions_of_answers(c.select(F.to_json(answer).alias("json")), "json")
    return told.select("page_id", "title", "rev_id", "username", "is_anonymous", F.md5("text").alias("digest"), "continue_at")
