"""Revisions out of the JSON answers of a wiki's query API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_broken_escapes

_REVISION = "struct<revid:bigint,timestamp:string,user:string,anon:string,minor:string,comment:string,`*`:string>"
_ANSWER = f"query struct<pages:map<string,struct<pageid:bigint,ns:int,title:string,revisions:array<{_REVISION}>>>>, `query-continue` struct<revisions:struct<rvstartid:bigint>>"


def revisions_of_answers(answers: DataFrame, json: str) -> DataFrame:
    """(page_id, title, rev_id, ts, username, is_anonymous, is_minor, comment, text, continue_at): one row per revision.

    Lone surrogates become U+FFFD; pages of other namespaces are left out; an
    answer that is no JSON has no rows.  ``continue_at`` is the revision that the next request starts from, null behind the last.
    """
    told = answers.select(F.from_json(without_broken_escapes(F.col(json)), _ANSWER).alias("a"))
    pages = told.select(F.col("a.`query-continue`.revisions.rvstartid").alias("continue_at"), F.explode(F.map_values("a.query.pages")).alias("p")).where("p.ns = 0")
    revs = pages.select("continue_at", F.col("p.pageid").alias("page_id"), F.col("p.title").alias("title"), F.explode("p.revisions").alias("r"))
    return revs.select(
        "page_id",
        "title",
        F.col("r.revid").alias("rev_id"),
        F.to_timestamp("r.timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.col("r.user").alias("username"),
        F.col("r.anon").isNotNull().alias("is_anonymous"),
        F.col("r.minor").isNotNull().alias("is_minor"),
        F.coalesce("r.comment", F.lit("")).alias("comment"),
        F.coalesce("r.`*`", F.lit("")).alias("text"),
        "continue_at",
    )


def moved_pages(known: DataFrame, told: DataFrame) -> DataFrame:
    """What the answers (page_id, title) say of stored pages: "keep", "rename" or, where a title now belongs to another page, "delete"."""
    by_title = told.select("title", F.col("page_id").alias("_now"))
    by_id = told.select("page_id", F.col("title").alias("_title"))
    both = known.join(by_title, "title", "left").join(by_id, "page_id", "left")
    action: Column = F.when(F.col("_now") != F.col("page_id"), "delete").when(F.col("_title") != F.col("title"), "rename").otherwise("keep")
    return both.select("page_id", "title", action.alias("action"))
