"""A paging API as a source: answers page by page, smaller ones where the server fails, and a stream of what is new.

``fetch(page, start, limit)`` asks for at most ``limit`` revisions of a page
from a revision number on and gives the answer as JSON; it raises ``ApiError`` where it may
be tried again.  It runs in tasks, so it must be importable or picklable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

LIMIT = 50
Fetch = Callable[[str, int, int], str]


class ApiError(Exception):
    """The server failed; a smaller request may do."""


def follow_up(answer: str) -> int | None:
    """The revision that the next request starts from; None behind the last."""
    return json.loads(answer).get("query-continue", {}).get("revisions", {}).get("rvstartid")


def pages_of(fetch: Fetch, page: str, start: int, limit: int = LIMIT) -> Iterator[tuple[int, str | None, str | None]]:
    """(start, answer, error) of a page's requests in turn.

    A request that fails is made again for half as many revisions, at least one; a server that
    leads back to where a request began has made no progress, which ends the page with an error.
    """
    while True:
        size, answer = limit, None
        while answer is None:
            try:
                answer = fetch(page, start, size)
                after = follow_up(answer)
            except (ApiError, ValueError) as error:
                answer = None
                if size < 2:
                    yield start, None, f"no answer: {error}"
                    return
                size //= 2
        yield start, answer, None
        if after is None:
            return
        if after <= start:
            yield start, None, f"no progress behind revision {start}"
            return
        start = after


def requests_of(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page, start): each page from behind the last of its ``known`` revisions (page, rev_id), or from its first."""
    last = known.groupBy("page").agg(F.max("rev_id").alias("_last"))
    return pages.join(last, "page", "left").select("page", (F.coalesce("_last", F.lit(-1)) + 1).alias("start"))


def answers(requests: DataFrame, fetch: Fetch, limit: int = LIMIT, tasks: int | None = None) -> DataFrame:
    """(page, start, json, error) of all answers for ``requests`` (page, start); pages are dealt to tasks, each asked in turn.

    ``api.revisions_of_answers`` reads the answers; rows with an error tell which pages are not whole.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page, start in zip(pdf["page"], pdf["start"], strict=True):
                for at, answer, error in pages_of(fetch, page, int(start), limit):
                    yield pd.DataFrame({"page": [page], "start": [at], "json": [answer], "error": [error]})

    rows = requests.select(F.col("page").cast("string").alias("page"), F.col("start").cast("long").alias("start"))
    dealt = rows.repartition(tasks, "page") if tasks else rows.repartition("page")
    return dealt.mapInPandas(asked, "page string, start long, json string, error string")


def changes_source(fetch: Fetch, limit: int = LIMIT) -> type[DataSource]:
    """A streaming source ``wiki_changes`` of the answers for one page (or feed of changes), option ``page``; the offset is a revision number.

    Register it with ``spark.dataSource.register``.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, page: str, start: int):
            self.page, self.start = page, start

        def initialOffset(self) -> dict:
            return {"start": self.start}

        def _asked(self, start: int, end: int | None) -> tuple[list[tuple], int]:
            rows = []
            for at, answer, error in pages_of(fetch, self.page, start, limit):
                if error is not None:
                    raise RuntimeError(error)
                told = [r["revid"] for p in json.loads(answer).get("query", {}).get("pages", {}).values() for r in p.get("revisions", [])]
                if not told or end is not None and min(told) >= end:
                    break
                rows.append((self.page, at, answer, None))
                start = max(start, max(told) + 1)
                if end is not None and start >= end:
                    break
            return rows, start

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, end = self._asked(start["start"], None)
            return iter(rows), {"start": end}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(self._asked(start["start"], end["start"])[0])

    class Changes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "wiki_changes"

        def schema(self) -> str:
            return "page string, start long, json string, error string"

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return Reader(self.options.get("page", ""), int(self.options.get("start", "0")))

    return Changes
