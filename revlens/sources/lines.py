"""Text formats of the analysis: statistics lines, reputation histories, robot lists and blobs of revisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The kinds of statistics lines and the labels of their fields, in the order of the format.
FIELDS = {
    "TextInc": {"PageId": "long", "rev0": "long", "uid0": "long", "uname0": "string", "rev1": "long", "uid1": "long", "uname1": "string", "text": "int", "left": "int", "n01": "int", "t01": "double"},
    "TextLife": {"PageId": "long", "rev0": "long", "uid0": "long", "uname0": "string", "NJudges": "int", "NewText": "int", "Life": "int"},
    "EditInc": {
        "PageId": "long", "Delta": "double", "rev0": "long", "uid0": "long", "uname0": "string", "rev1": "long", "uid1": "long", "uname1": "string",
        "rev2": "long", "uid2": "long", "uname2": "string", "d01": "double", "d02": "double", "d12": "double", "dp2": "double", "n01": "int", "n12": "int", "t01": "double", "t12": "double",
    },
    "EditLife": {"PageId": "long", "rev0": "long", "uid0": "long", "uname0": "string", "NJudges": "int", "Delta": "double", "AvgSpecQ": "double"},
}
#: Lines of this many characters or fewer hold nothing.
SHORTEST = 7
#: A blob is full at so many bytes, or at so many bytes and revisions.
MAX_BLOB, MIN_BLOB, MANY_REVISIONS = 10_000_000, 1_000_000, 20
_ENTRY = re.compile(r"\((\d+) (\d+) (\d+)\)")


_FIELD = r'([A-Za-z][A-Za-z0-9]*):\s*("(?:[^"\\]|\\.)*"|[-+0-9.eE]+)'


def _fields(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` with the labels and the values of each line as arrays, from one pass for each."""
    found = lambda group: F.regexp_extract_all(F.col(column), F.lit(_FIELD), F.lit(group))
    return lines.select(F.col(column).alias("_line"), found(1).alias("_labels"), found(2).alias("_values"))


def _field(label: str, kind: str) -> Column:
    """A labelled field; null if the line has none."""
    value = F.get("_values", F.array_position("_labels", label).cast("int") - 1)
    if kind != "string":
        return value.try_cast(kind)
    return F.when(value.startswith('"'), F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"\\(.)", "$1"))


def parse_statistics(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The lines of one kind: ``time`` and a column for each label; old lines without some fields have nulls there."""
    line = F.col(column)
    rows = _fields(lines.where((F.length(line) > SHORTEST) & ~line.contains("\x00") & line.startswith(kind + " ")), column)
    time = F.get(F.split(F.ltrim(F.substring("_line", len(kind) + 1, 40)), r"\s+"), F.lit(0)).try_cast("double")
    return rows.select(time.alias("time"), *[_field(label, of).alias(label) for label, of in FIELDS[kind].items()]).where("time is not null")


def read_statistics(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse_statistics(spark.read.text(path), kind)


def page_titles(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = _fields(lines.where(F.col(column).startswith("Page:")), column)
    return rows.select(_field("Page", "long").alias("page_id"), _field("Title", "string").alias("title"))


def statistics_lines(rows: DataFrame, kind: str) -> DataFrame:
    """The text form of rows that ``parse_statistics`` gives; null fields are left out."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    shown = {"string": quoted, "double": lambda c: F.format_string("%.5f", c)}
    parts = [F.when(F.col(label).isNotNull(), F.concat(F.lit(f"{label}: "), shown.get(of, lambda c: c.cast("string"))(F.col(label)))) for label, of in FIELDS[kind].items()]
    return rows.select(F.concat_ws(" ", F.lit(kind), F.format_string("%.0f", F.col("time")), *parts).alias("value"))


def parse_reputations(lines: DataFrame, column: str = "value") -> DataFrame:
    """``time user old_bin new_bin [reputation "name"]`` by spaces."""
    f = F.regexp_extract_all(F.col(column), F.lit(r'("(?:[^"\\]|\\.)*"|\S+)'), F.lit(1))
    at = lambda i, of: F.get(f, F.lit(i)).try_cast(of)
    return lines.where(F.size(f) >= 4).select(
        at(0, "double").alias("time"), at(1, "long").alias("user_id"), at(2, "int").alias("old_bin"), at(3, "int").alias("new_bin"), at(4, "double").alias("rep"), F.regexp_replace(F.get(f, F.lit(5)), r'^"|"$', "").alias("username")
    )


def final_reputation_lines(users: DataFrame, bin: Column) -> DataFrame:
    """Users with a reputation, as the lines that close a history: time 0 and old bin -1."""
    named = users.select("user_id", "rep", "username", bin.alias("_bin")).where((F.col("_bin") > 0) | (F.col("rep") > 0))
    return named.select(F.format_string('0. %d -1 %d %f "%s"', "user_id", "_bin", "rep", "username").alias("value"))


def write_statistics(rows: DataFrame, kind: str, path: str, compression: str = "gzip") -> None:
    """Rows of one kind as statistics lines in compressed text files."""
    statistics_lines(rows, kind).write.text(path, compression=compression)


def order_breaks(lines: DataFrame, place: str, time: str) -> DataFrame:
    """The rows whose time is before that of the row before, by ``place``, with ``before``: where a file is not sorted.

    Places are such as ``monotonically_increasing_id`` gives: rows are compared within a partition, and the last of each partition with what follows.
    """
    part = F.shiftright(place, 33)
    own = Window.partitionBy("_part").orderBy(place)
    rows = lines.withColumn("_part", part)
    edges = rows.groupBy("_part").agg(F.max_by(time, place).alias("_last"))
    before = edges.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))  # a row for each partition
    told = rows.join(F.broadcast(before), "_part").withColumn("before", F.coalesce(F.lag(time).over(own), "_edge"))
    return told.where(F.col(time) < F.col("before")).drop("_part", "_edge")


def bad_robot_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines of a list of robots that hold no quoted name, but are not empty."""
    return lines.where(~F.col(column).rlike(r'^\s*"((?:[^"\\]|\\.)+)"\s*$') & (F.trim(column) != "")).select(column)


def robot_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """One quoted name a line; other lines are bad and skipped."""
    name = F.regexp_extract(column, r'^\s*"((?:[^"\\]|\\.)*)"\s*$', 1)
    return lines.select(F.regexp_replace(name, r"\\(.)", "$1").alias("name")).where("name <> ''").distinct()


def robots_of_markup(rows: DataFrame, text: str) -> DataFrame:
    """Names listed as ``{{BotS|name|...}}``."""
    return rows.select("*", F.explode(F.regexp_extract_all(text, F.lit(r"\{\{BotS\|(.*?)\|(.*)\}\}"), F.lit(1))).alias("robot"))


def packed(revs: DataFrame, key: str, rev_id: str, text: str, least: int = MIN_BLOB, most: int = MAX_BLOB, many: int = MANY_REVISIONS) -> DataFrame:
    """``revs`` with ``blob_id``: a key's revisions, by id, go on to its next blob when the open one has ``most`` bytes, or ``least`` bytes and ``many`` revisions.

    The rule is a fold over ids and sizes, which stream by; no key's history is held in one row.  Ids are
    unique within a key, and neither they nor the texts are null.
    """
    kinds = dict(revs.dtypes)

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, size, n = None, [], 0, 0
        for pdf in batches:
            done = []
            for k, r, x in zip(pdf["k"].tolist(), pdf["r"].tolist(), pdf["x"].tolist()):
                if not first or k != at:
                    done += [(at, first)] if first else []
                    at, first, size, n = k, [r], 0, 0
                elif size >= most or (size >= least and n >= many):
                    first.append(r)
                    size, n = 0, 0
                size, n = size + x, n + 1
            yield pd.DataFrame(done, columns=["_k", "_first"])
        if first:
            yield pd.DataFrame([(at, first)], columns=["_k", "_first"])

    sizes = revs.select(F.col(key).alias("k"), F.col(rev_id).alias("r"), F.octet_length(text).cast("long").alias("x"))
    blobs = sizes.repartition("k").sortWithinPartitions("k", "r").mapInPandas(firsts, f"_k {kinds[key]}, _first array<{kinds[rev_id]}>")
    begun = F.size(F.filter("_first", lambda f: f <= F.col(rev_id)))
    return revs.join(blobs, F.col(key) == F.col("_k")).select(*revs.columns, (begun - 1).alias("blob_id"))


def revisions_of_blob(blobs: DataFrame, key: str | list[str], blob: str) -> DataFrame:
    """The revisions in blobs ``(id start length)...:texts``; starts count from behind the colon."""
    keys = [key] if isinstance(key, str) else key
    kinds = dict(blobs.dtypes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a slice costs its own length here, not its offset in the blob as in SQL
        for pdf in batches:
            for *of, whole in pdf.itertuples(index=False, name=None):
                head, _, body = whole.partition(":")
                rows = [(*of, r, body[at : at + n]) for r, at, n in (map(int, x) for x in _ENTRY.findall(head))]
                yield pd.DataFrame(rows, columns=[*keys, "rev_id", "text"])

    return blobs.select(*keys, blob).where(F.col(blob).isNotNull()).mapInPandas(cut, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rev_id long, text string"]))


def blob_of_revisions(revs: DataFrame, key: str | list[str], rev_id: str, text: str) -> DataFrame:
    """The texts of each ``key`` in one blob, by revision id; ``packed`` bounds what a key holds, with ``blob_id`` as part of it."""
    keys = [key] if isinstance(key, str) else key
    before = Window.partitionBy(*keys).orderBy("r", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = revs.select(*keys, F.col(rev_id).alias("r"), F.col(text).alias("t")).withColumn("at", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0)))
    kept = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "at", "t"))).alias("_all"))
    head = F.transform("_all", lambda x: F.format_string("(%d %d %d)", x["r"], x["at"], F.length(x["t"])))
    return kept.select(*keys, F.concat(F.array_join(head, ""), F.lit(":"), F.array_join(F.transform("_all", lambda x: x["t"]), "")).alias("blob"))
