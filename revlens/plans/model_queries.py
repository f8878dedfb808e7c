"""Queries of features, models, selection and stored tables, with their twins.

Revisions are ``events`` (page = event_type, author = user_id or 0 for every
seventh, ts) with judgements and a histogram that follow from their numbers;
the reputation of a user is that of the customer of the same number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, models, selection, store
from ..operators import reputation as R
from .registry import crc32_sql, query, table

NOW = "2024-02-15 00:00:00"
ORDER = ["ts", "revision"]

_REVS = """
SELECT event_type AS page, event_id AS revision, CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END AS author, 'u' || (user_id % 40) AS name, ts,
  (event_id % 4)::DOUBLE AS judge_weight, (event_id % 4) * ((event_id * 13 % 21) / 10.0 - 1) AS total_quality, (event_id * 11 % 20) / 10.0 - 1 AS min_quality,
  (event_id * 17 % 90) / 10.0 AS delta, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 40 END AS comment_len,
  [((event_id * (i + 3)) % (11 + i))::DOUBLE for i in range(10)] AS hist FROM events"""

_SUM = lambda h: f"list_sum({h})"
_CHANGE = "hist[{i}] - prev_hist[{i}]"
_FEATURES = f"""
SELECT *, CASE WHEN judge_weight > 0 THEN total_quality / judge_weight ELSE 0 END AS avg_quality,
  ln(1 + abs(floor(epoch(next_ts)) - floor(epoch(ts)))) AS logtime_next, ln(1 + abs(floor(epoch(ts)) - floor(epoch(prev_ts)))) AS logtime_prev,
  hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 AS hour_of_day,
  CASE WHEN length = 0 OR prev_length = 0 THEN 1 ELSE greatest(delta, abs(length - prev_length)) / greatest(length, prev_length) END AS risk,
  {", ".join(f"hist[{i + 1}] AS hist{i}, prev_hist[{i + 1}] / (1 + prev_length) AS p_prev_hist{i}, sign({_CHANGE.format(i=i + 1)}) * ln(1 + abs({_CHANGE.format(i=i + 1)})) AS l_delta_hist{i}" for i in range(10))},
  author = 0 AS anon, ((author > 0) = (prev_author > 0)) AND name = prev_name AS prev_same_author, ((author > 0) = (next_author > 0)) AND name = next_name AS next_same_author,
  CASE WHEN min_quality < 1 THEN (judge_weight - total_quality) / (1 - min_quality) ELSE 0 END AS max_dissent, (judge_weight - total_quality) / 2 AS max_revert
FROM (SELECT *, {_SUM("hist")} AS length, {_SUM("prev_hist")} AS prev_length FROM (
  SELECT r.*, coalesce(c_acctbal, 0) / 10000 AS reputation, coalesce(lag(author) OVER w, 0) AS prev_author, coalesce(lag(name) OVER w, '') AS prev_name, coalesce(lag(ts) OVER w, ts) AS prev_ts,
    coalesce(lag(hist) OVER w, [0.0 for i in range(10)]) AS prev_hist, coalesce(lead(author) OVER w, 0) AS next_author, coalesce(lead(name) OVER w, '') AS next_name, coalesce(lead(ts) OVER w, TIMESTAMP '{NOW}') AS next_ts
  FROM ({_REVS}) r LEFT JOIN customer ON c_custkey = author WINDOW w AS (PARTITION BY page ORDER BY ts, revision)))"""


def _features(spark, sf_dir):
    n = F.col("event_id")
    revs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("page"), n.alias("revision"), F.when(n % 7 == 0, 0).otherwise(F.col("user_id")).alias("author"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("name"), "ts",
        (n % 4).cast("double").alias("judge_weight"), ((n % 4) * (n * 13 % 21 / 10 - 1)).alias("total_quality"), (n * 11 % 20 / 10 - 1).alias("min_quality"),
        (n * 17 % 90 / 10).alias("delta"), F.when(n % 5 != 0, n % 40).alias("comment_len"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (n * (i + 3) % (11 + i)).cast("double")).alias("hist"),
    )
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"), (F.col("c_acctbal") / 10000).alias("reputation"))
    return features.revision_features(revs, users, F.lit(NOW).cast("timestamp"), ORDER)


_SHOWN = ["avg_quality", "logtime_next", "logtime_prev", "hour_of_day", "risk", "max_dissent", "max_revert", "reputation", "l_delta_hist0", "l_delta_hist9", "p_prev_hist5", "length", "prev_length"]


#: A risk is a quotient of tenths and small lengths: it has ties at six digits, none at ten.
_DIGITS = {c: 10 if c == "risk" else 6 for c in _SHOWN}


@query(f"SELECT revision, {', '.join(f'round({c}, {n}) AS {c}' for c, n in _DIGITS.items())}, anon, prev_same_author, next_same_author FROM ({_FEATURES})")
def all_revision_features(spark, sf_dir):
    return _features(spark, sf_dir).select("revision", *[F.round(c, n).alias(c) for c, n in _DIGITS.items()], "anon", "prev_same_author", "next_same_author")


# The trees of the models again, as SQL.
_VANDALISM = """0.134 + CASE WHEN min_quality < -0.662 THEN 0.891 + CASE WHEN l_delta_hist0 < 0.347 THEN -0.974 ELSE 0.151 END + CASE WHEN avg_quality < -0.117 THEN -0.002 ELSE -0.695 END ELSE -1.203 END
  + CASE WHEN reputation < 0.049 THEN 0.358 + CASE WHEN p_prev_hist5 < 0.01 THEN 0.519 ELSE -0.298 + CASE WHEN l_delta_hist2 < 0.347 THEN -1.125 ELSE 1.113 END + CASE WHEN avg_quality < 0.156 THEN 0.531 ELSE -2.379 END END ELSE 0 END
  + CASE WHEN logtime_next < 2.97 THEN 1.025 ELSE 0.035 + CASE WHEN delta < 3.741 THEN -0.232 ELSE 0.212 END END"""
_AT_ONCE = """0.134 + CASE WHEN l_delta_hist0 < 0.347 THEN -1.018 + CASE WHEN hist0 < 0.5 THEN -0.113 ELSE 0.528 END
  ELSE 0.766 + CASE WHEN l_delta_hist3 < 0.347 THEN 0.026 + CASE WHEN l_delta_hist4 < 0.347 THEN 0.1 ELSE -0.751 END ELSE -0.962 END + CASE WHEN p_prev_hist0 < 0.004 THEN 0.094 ELSE -0.493 END END
  + CASE WHEN anon THEN -0.576 ELSE 0.312 END + CASE WHEN p_prev_hist9 < 0.115 THEN -0.333 ELSE 0.182 + CASE WHEN hist7 < 1.5 THEN 1.217 ELSE -0.029 END END
  + CASE WHEN delta < 2.901 THEN -0.251 ELSE 0.182 END + CASE WHEN coalesce(comment_len, 0) < 18.5 THEN 0.123 ELSE -0.229 END"""
_SELECTION = """0.134 + CASE WHEN min_quality < -0.662 THEN 0.891 + CASE WHEN l_delta_hist0 < 0.347 THEN -0.974 ELSE 0.151 END + CASE WHEN max_dissent < 0.171 THEN -1.329 ELSE 0.086 END ELSE -1.203 END
  + CASE WHEN reputation < 0.049 THEN 0.358 ELSE -1.012 + CASE WHEN p_prev_hist5 < 0.01 THEN 0.482 ELSE -0.376 + CASE WHEN avg_quality < 0.156 THEN 0.5 ELSE -2.625 END + CASE WHEN l_delta_hist2 > 0.347 THEN -0.757 ELSE 1.193 END END END
  + CASE WHEN logtime_next < 2.74 THEN 1.188 ELSE 0.045 + CASE WHEN delta < 3.741 THEN -0.255 ELSE 0.168 END END"""
_SCORED = f"SELECT *, 1 / (1 + exp({_SELECTION})) AS quality, 1 / (1 + exp(-({_VANDALISM}))) AS vandalism FROM ({_FEATURES})"


def _scored(spark, sf_dir):
    return models.vandalism(models.selection_quality(_features(spark, sf_dir)))


@query(f"SELECT revision, round(1 / (1 + exp(-({_VANDALISM}))), 8) AS vandalism FROM ({_FEATURES})")
def vandalism_score(spark, sf_dir):
    return models.vandalism(_features(spark, sf_dir)).select("revision", F.round("vandalism", 8).alias("vandalism"))


@query(f"SELECT revision, round(1 / (1 + exp(-({_AT_ONCE}))), 8) AS vandalism FROM ({_FEATURES})")
def vandalism_zd_score(spark, sf_dir):
    return models.vandalism_at_once(_features(spark, sf_dir)).select("revision", F.round("vandalism", 8).alias("vandalism"))


@query(f"SELECT revision, round(quality, 8) AS quality FROM ({_SCORED})")
def selection_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("revision", F.round("quality", 8).alias("quality"))


_AGE = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch({{}})))"
_BEST = f"""
SELECT *, row_number() OVER (PARTITION BY page ORDER BY value DESC, risk, ts DESC, revision DESC) AS rank FROM (
  SELECT *, quality * discount AS value FROM (
    SELECT *, 200 / (200 + ago + {_AGE.format("ts")} / 604800) AS discount, 200 / (200 + ago + {_AGE.format("ts")} / 604800) - 200 / (200 + ago + 1 + {_AGE.format("prev_ts")} / 604800) AS forced FROM (
      SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts DESC, revision DESC) AS ago FROM ({_SCORED})) WHERE ago <= 100))"""


@query(f"SELECT page, revision, rank, round(value, 8) AS value, round(discount, 8) AS discount, round(forced, 8) AS forced, ago AS revisions_ago FROM ({_BEST}) WHERE rank <= 10")
def select_best_revisions(spark, sf_dir):
    best = selection.best_revisions(_scored(spark, sf_dir), F.lit(NOW).cast("timestamp"), ORDER, 10)
    return best.select("page", "revision", "rank", *[F.round(c, 8).alias(c) for c in ("value", "discount", "forced")], "revisions_ago")


@query(f"SELECT page, revision, round(quality, 8) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts DESC, revision DESC) AS ago FROM ({_SCORED})) WHERE ago <= 40 AND quality < 0.3")
def recent_vandalism(spark, sf_dir):
    found = selection.recent_vandalism(_scored(spark, sf_dir), F.lit(NOW).cast("timestamp"), ORDER)
    return found.select("page", "revision", F.round("quality", 8).alias("quality"))


@query(f"SELECT page, revision FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY page ORDER BY ts >= TIMESTAMP '2024-01-20' DESC, vandalism, ts DESC, revision DESC) = 1")
def least_vandalism(spark, sf_dir):
    return selection.least_vandalised(_scored(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"), ORDER).select("page", "revision")


@query(f"""
SELECT p.page, coalesce(wanted, last) AS revision FROM (SELECT event_type AS page, CASE WHEN event_type < 'd' THEN min(event_id) END AS wanted FROM events GROUP BY 1) p
LEFT JOIN (SELECT page, arg_max(revision, (ts, revision)) AS last FROM ({_REVS}) WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY page) l USING (page)""")
def best_revision_feed(spark, sf_dir):
    pages = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("page")).agg(F.min("event_id").alias("first")).select("page", F.when(F.col("page") < "d", F.col("first")).alias("wanted"))
    revs = table(spark, sf_dir, "events").select(F.col("event_type").alias("page"), F.col("event_id").alias("revision"), "ts")
    return selection.best_feed(pages, revs, F.lit("2024-01-20").cast("timestamp"), ORDER)


@query(f"SELECT page, revision, name, ts, round(quality, 4) AS quality, round(risk, 4) AS risk, delta, length FROM ({_SCORED})")
def quality_report(spark, sf_dir):
    return selection.quality_report(_scored(spark, sf_dir))


# --- stored tables -----------------------------------------------------------


def _votes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("revision"), F.col("user_id").alias("voter"), F.col("event_id").alias("vote"), "ts", (F.col("event_id") % 3 == 0).alias("processed"))


_VOTES = "SELECT event_type AS revision, user_id AS voter, event_id AS vote, ts, event_id % 3 = 0 AS processed FROM events"


@query(f"SELECT vote, voter FROM ({_VOTES}) WHERE NOT processed ORDER BY ts, vote LIMIT 100")
def unprocessed_votes(spark, sf_dir):
    return store.open_votes(_votes(spark, sf_dir), ["ts", "vote"], 100).select("vote", "voter")


@query(f"SELECT vote, processed OR voter IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS processed FROM ({_VOTES})")
def votes_marked(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("voter"))
    return store.mark(_votes(spark, sf_dir), rich, "voter", "processed", F.lit(True)).select("vote", "processed")


@query(f"SELECT vote FROM ({_VOTES}) QUALIFY row_number() OVER (PARTITION BY revision, voter ORDER BY ts, vote) = 1")
def votes_cast(spark, sf_dir):
    return store.cast_votes(_votes(spark, sf_dir), ["ts", "vote"]).select("vote")


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def last_colored_revision(spark, sf_dir):
    return store.last_of(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role")


@query("""
SELECT coalesce(o_custkey, c_custkey) AS user, coalesce(o_orderpriority, c_mktsegment) AS info, c_acctbal AS rep FROM customer
FULL JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def info_upsert(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("info"), F.col("c_acctbal").alias("rep"))
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("info"), "o_orderdate", "o_orderkey")
    return store.upsert(users, changes, ["user"], ["o_orderdate", "o_orderkey"])


@query("""
SELECT coalesce(c_custkey, o_custkey) AS user, round(coalesce(c_acctbal, 0.1) + coalesce(s, 0), 2) AS rep FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) c
FULL JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def reputation_added(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("rep"))
    more = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("rep"))
    return store.added(users, more, "user", "rep", 0.1).select("user", F.round("rep", 2).alias("rep"))


def _queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "unprocessed").otherwise("processing")
    return o.select(F.col("o_orderkey").alias("page"), state.alias("state"), (F.col("o_orderkey") % 5).alias("priority"), F.col("o_orderdate").alias("requested_on"))


_QUEUE = "SELECT o_orderkey AS page, CASE WHEN o_orderstatus = 'O' THEN 'unprocessed' ELSE 'processing' END AS state, o_orderkey % 5 AS priority, o_orderdate AS requested_on FROM orders"
_FRONT = f"SELECT page FROM ({_QUEUE}) WHERE state = 'unprocessed' AND priority > 0 ORDER BY priority DESC, requested_on, page LIMIT 40"


@query(f"SELECT page, CASE WHEN page IN ({_FRONT}) THEN 'processing' ELSE state END AS state FROM ({_QUEUE}) WHERE NOT (state = 'processing' AND page % 2 = 0)")
def queue_step(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    done = queue.where("state = 'processing' and page % 2 = 0")
    return store.dequeued(queue, store.queue_front(queue, 40), done).select("page", "state")


@query("""
SELECT p_partkey AS page, CASE WHEN p_partkey % 10 = 3 THEN (SELECT p2.p_name || '#' || p2.p_partkey FROM part p2 WHERE p2.p_partkey = part.p_partkey + 1) WHEN p_partkey % 10 = 4 THEN NULL ELSE p_name || '#' || p_partkey END AS title FROM part""")
def titles_renamed(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.concat_ws("#", "p_name", "p_partkey").alias("title"))
    taken = pages.where("page % 10 = 4").select((F.col("page") - 1).alias("page"), "title")
    return store.titles_renamed(pages, taken)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page"))
    return store.without_pages(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""
SELECT slot, greatest(round(sum(w), 4), 0) AS weight FROM (
  SELECT l_linenumber AS slot, l_quantity AS w FROM lineitem UNION ALL SELECT l_linenumber, l_discount - 40 FROM lineitem WHERE l_returnflag = 'R') GROUP BY slot""")
def histogram_merged(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stored = lines.select(F.col("l_linenumber").alias("slot"), F.col("l_quantity").alias("weight"))
    less = lines.where("l_returnflag = 'R'").select(F.col("l_linenumber").alias("slot"), (F.col("l_discount") - 40).alias("weight"))
    return store.histogram_merged(stored, less).select("slot", F.round("weight", 4).alias("weight"))


@query("""
WITH users AS (SELECT c_custkey AS user, c_name AS name FROM customer WHERE c_custkey % 4 > 0), fresh AS (SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey % 4 = 0)
SELECT * FROM users UNION ALL SELECT (SELECT max(user) FROM users) + row_number() OVER (ORDER BY name), name FROM fresh""")
def user_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    return store.user_numbers(c.where("user % 4 > 0"), c)


# --- columns -----------------------------------------------------------------


#: Two authors of one name: of its signature (two others, and every third time the author's own number) and what adding them makes of it.
_SIGNED = f"""
SELECT c_custkey, h, 5 + (7 << 10) + ((CASE WHEN c_custkey % 3 = 0 THEN h ELSE 9 END) << 20) AS s, g FROM (
  SELECT c_custkey, {crc32_sql("c_custkey || ' ' || c_name")} % 1023 + 1 AS h, {crc32_sql("(c_custkey + 1) || ' ' || c_name")} % 1023 + 1 AS g FROM customer)"""


@query(f"""
SELECT c_custkey, h AS number, held, CASE WHEN held THEN s ELSE h + ((s & 1048575) << 10) END AS one,
  CASE WHEN g IN (CASE WHEN held THEN s & 1023 ELSE h END, CASE WHEN held THEN (s >> 10) & 1023 ELSE s & 1023 END, CASE WHEN held THEN s >> 20 ELSE (s >> 10) & 1023 END)
    THEN CASE WHEN held THEN s ELSE h + ((s & 1048575) << 10) END
    ELSE g + (((CASE WHEN held THEN s ELSE h + ((s & 1048575) << 10) END) & 1048575) << 10) END AS two, true AS nobody
FROM (SELECT *, h IN (s & 1023, (s >> 10) & 1023, s >> 20) AS held FROM ({_SIGNED}))""")
def signature_members(spark, sf_dir):
    author, word = F.col("c_custkey"), F.col("c_name")
    number = T.author_hash(author, word)
    sig = T.pack_signature(F.lit(5).cast("long"), F.lit(7).cast("long"), F.when(author % 3 == 0, number).otherwise(F.lit(9).cast("long")))
    told = table(spark, sf_dir, "customer").select("c_custkey", "c_name", number.alias("number"), sig.alias("sig")).withColumn("one", T.add_to_signature(F.col("sig"), author, word))
    return told.select("c_custkey", "number", T.in_signature(F.col("sig"), author, word).alias("held"), "one", T.add_to_signature(F.col("one"), author + 1, word).alias("two"), T.in_signature(F.col("sig"), F.lit(0), word).alias("nobody"))


@query("""
SELECT word, count(*) AS n FROM (
  SELECT translate(CASE WHEN suffix(w, '.') OR suffix(w, ':') OR suffix(w, ';') OR suffix(w, ',') THEN substr(w, 1, length(w) - 1) ELSE w END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS w FROM conversations)) GROUP BY word""")
def canonical_forms(spark, sf_dir):
    """Words between blanks in their canonical form: one closing stop goes."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return words.groupBy(T.canonical_word(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n]+$', '')) AS stripped, md5(regexp_replace(regexp_replace(text, '( \\n\\t)+', ' ', 'g'), '^ | $', '', 'g')) AS spaced FROM documents WHERE text IS NOT NULL""")
def space_normalized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(T.stripped_end(F.col("text"))).alias("stripped"), F.md5(T.normal_space(F.col("text"))).alias("spaced"))


@query("""
SELECT event_id, (event_id % 9)::VARCHAR AS judges, round(value, 3)::VARCHAR AS delta, strftime(ts, '%Y%m%d%H%M%S') AS compact, floor(epoch(ts))::BIGINT AS seconds, CASE WHEN event_id % 2 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS after_1970 FROM events""")
def quality_record_fields(spark, sf_dir):
    info = F.concat(F.lit("((n_edit_judges "), F.col("event_id") % 9, F.lit(")(delta "), F.round("value", 3), F.lit(")(word_trust_histogram (1 2)))"))
    compact = T.compact_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    old = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("1950"), F.substring(compact, 5, 10))).otherwise(compact)
    return table(spark, sf_dir, "events").select(
        "event_id", T.subfield(info, "n_edit_judges").alias("judges"), T.subfield(info, "delta").alias("delta"), compact.alias("compact"), T.epoch_of(compact).alias("seconds"), T.epoch_of(old).alias("after_1970")
    )


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM pages")
def xml_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("digest"))


@query("""
SELECT c_custkey, c_custkey % 11 = 0 OR lower(name) LIKE '%bot' AS robot, round(CASE WHEN c_custkey % 11 = 0 OR lower(name) LIKE '%bot' THEN 0 ELSE 1 - pow(1 - 0.2, 1 - exp(-abs(c_acctbal) / 3600)) END, 8) AS read_on_line
FROM (SELECT *, c_name || CASE WHEN c_custkey % 5 = 0 THEN 'Bot' ELSE '' END AS name FROM customer)""")
def robots_and_reading(spark, sf_dir):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, "Bot").otherwise(""))
    robot = T.is_robot(F.col("c_custkey") % 11 == 0, name)
    return table(spark, sf_dir, "customer").select("c_custkey", robot.alias("robot"), F.round(T.read_share(F.lit(0.2), F.abs("c_acctbal"), 3600.0, robot), 8).alias("read_on_line"))
