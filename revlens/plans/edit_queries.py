"""Queries of edit lists, with their twins.

The lines of an order stand for the edits of a pair of texts: a third each
moves, deletions and insertions, at places that follow from the line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edits as X
from .registry import query, table


def _first(spark, sf_dir) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    kind = F.when((n + q) % 3 == 0, "del").when((n + q) % 3 == 1, "ins").otherwise("mov")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), kind.alias("kind"), (n * 9).alias("i"), (n * 5 % 7 * 9).alias("j"), (q % 9 + 1).alias("l"))
    return rows.select("pair", "kind", F.when(F.col("kind") != "ins", F.col("i")).alias("i"), F.when(F.col("kind") != "del", F.col("j")).alias("j"), "l")


def _second(spark, sf_dir) -> DataFrame:
    e = _first(spark, sf_dir)
    return e.select("pair", "kind", (F.col("i") + 4).alias("i"), (F.col("j") + 2).alias("j"), F.greatest(F.col("l") - 2, F.lit(1)).alias("l"))


_FIRST = """
SELECT pair, kind, CASE WHEN kind <> 'ins' THEN i END AS i, CASE WHEN kind <> 'del' THEN j END AS j, l FROM (
  SELECT l_orderkey AS pair, CASE (l_linenumber + trunc(l_quantity)::INT) % 3 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' ELSE 'mov' END AS kind,
    (l_linenumber * 9)::INT AS i, (l_linenumber * 5 % 7 * 9)::INT AS j, (trunc(l_quantity)::INT % 9 + 1)::INT AS l FROM lineitem)"""
_SECOND = f"SELECT pair, kind, i + 4 AS i, j + 2 AS j, greatest(l - 2, 1) AS l FROM ({_FIRST})"
_LENGTHS = "SELECT DISTINCT l_orderkey AS pair, 80 AS n FROM lineitem"


def _lengths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.lit(80).alias("n")).distinct()


@query(f"""
SELECT pair, string_agg(e, ' ' ORDER BY coalesce(i, 1099511627776), coalesce(j, -1), e) AS edits FROM (
  SELECT *, CASE kind WHEN 'mov' THEN 'Mov(' || i || ', ' || j || ', ' || l || ')' WHEN 'del' THEN 'Del(' || i || ', ' || l || ')' ELSE 'Ins(' || j || ', ' || l || ')' END AS e FROM ({_FIRST})) GROUP BY pair""")
def edits_rendered(spark, sf_dir):
    return X.rendered(_first(spark, sf_dir))


@query(f"SELECT pair, coalesce(sum(l) FILTER (i IS NOT NULL), 0)::BIGINT AS left_words, coalesce(sum(l) FILTER (j IS NOT NULL), 0)::BIGINT AS right_words FROM ({_FIRST}) GROUP BY pair")
def diff_cover(spark, sf_dir):
    return X.cover(_first(spark, sf_dir))


@query(f"""
SELECT pair, coalesce(upto, 0) AS start, place - coalesce(upto, 0) AS length FROM (
  SELECT *, max(stop) OVER (PARTITION BY pair ORDER BY place, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (
    SELECT pair, i AS place, i + l AS stop FROM ({_FIRST}) WHERE i IS NOT NULL UNION ALL SELECT pair, n, n FROM ({_LENGTHS}))) WHERE place > coalesce(upto, 0)""")
def interval_complement(spark, sf_dir):
    return X.complement(_first(spark, sf_dir), _lengths(spark, sf_dir), left=True)


@query(f"""
SELECT pair, CASE WHEN i2 IS NOT NULL AND j2 IS NOT NULL THEN 'mov' WHEN i2 IS NOT NULL THEN 'del' ELSE 'ins' END AS kind, i2 AS i, j2 AS j, l2 AS l FROM (
  SELECT a.pair, a.i + greatest(a.j, b.i) - a.j AS i2, b.j + greatest(a.j, b.i) - b.i AS j2, least(a.j + a.l, b.i + b.l) - greatest(a.j, b.i) AS l2
  FROM ({_FIRST}) a JOIN ({_SECOND}) b ON a.pair = b.pair AND a.j < b.i + b.l AND b.i < a.j + a.l) WHERE i2 IS NOT NULL OR j2 IS NOT NULL""")
def zip_edit_intervals(spark, sf_dir):
    return X.composed(_first(spark, sf_dir), _second(spark, sf_dir))


@query(f"""
SELECT p.pair, round(coalesce(c, 0) / 80, 8) AS cost FROM ({_LENGTHS}) p LEFT JOIN (
  SELECT a.pair, sum(a.l * b.l) AS c FROM ({_FIRST}) a JOIN ({_FIRST}) b ON a.pair = b.pair AND a.kind = 'mov' AND b.kind = 'mov' AND a.i < b.i AND a.j > b.j GROUP BY a.pair) USING (pair)""")
def move_cost(spark, sf_dir):
    return X.move_cost(_first(spark, sf_dir), _lengths(spark, sf_dir)).select("pair", F.round("cost", 8).alias("cost"))


@query("""
WITH t AS (
  SELECT l_orderkey AS pair, l_linenumber AS middle, l_linenumber * 7 AS a, trunc(l_quantity)::INT AS b, l_linenumber * 7 + l_partkey % 90 AS na, trunc(l_quantity)::INT + l_suppkey % 400 AS nb FROM lineitem),
c AS (SELECT pair, middle, CASE WHEN a < b THEN a ELSE b END AS open, (a + 1)::DOUBLE / (na + 1) AS share_a, (b + 1)::DOUBLE / (nb + 1) AS share_b FROM t)
SELECT pair, middle, open FROM c WHERE open <= 100 AND (share_a <= 0.2 OR share_b <= 0.2) QUALIFY row_number() OVER (PARTITION BY pair ORDER BY open, middle DESC) = 1""")
def best_intermediary(spark, sf_dir):
    a, b = F.col("l_linenumber") * 7, F.col("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("middle"), a.alias("left"), b.alias("right"), (a + F.col("l_partkey") % 90).alias("n_left"), (b + F.col("l_suppkey") % 400).alias("n_right"))
    return X.best_intermediary(lines)


@query("""
SELECT doc_id, count(*) AS n_pairs, max(n) AS most_places, sum(first_at)::BIGINT AS first_places FROM (
  SELECT doc_id, a, b, count(*) AS n, min(place) AS first_at FROM (
    SELECT doc_id, w[place + 1] AS a, w[place + 2] AS b, place FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS place FROM (
      SELECT doc_id, list_filter(string_split_regex(text, '[,;.: \\n\\t]+'), lambda x: x <> '') AS w FROM documents))) GROUP BY ALL) GROUP BY doc_id""")
def bigram_index(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("key"), T.plain_words(F.col("text")).alias("words"))
    pairs = words.where("size(words) > 1").select("key", X.adjacent_words("words").alias("pairs"))
    sums = F.aggregate("pairs", F.lit(0).cast("long"), lambda total, p: total + p["places"][0])
    return pairs.select(F.col("key").alias("doc_id"), F.size("pairs").cast("long").alias("n_pairs"), F.array_max(F.transform("pairs", lambda p: F.size(p["places"]))).cast("long").alias("most_places"), sums.alias("first_places"))


@query("""
SELECT l_orderkey, l_linenumber, -l_linenumber AS length, -(l_linenumber % 3) AS chunk, round(abs((5 + l_linenumber / 2) / 60 - (l_quantity + l_linenumber / 2) / 90), 8) AS off
FROM lineitem""")
def match_order(spark, sf_dir):
    n = F.col("l_linenumber")
    key = X.match_quality(n, F.lit(5), F.lit(60), F.col("l_quantity"), F.lit(90), n % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k")).select("l_orderkey", "l_linenumber", "k.length", "k.chunk", F.round("k.off", 8).alias("off"))
