"""Keyed state of a page: its events in order, late ones, and what the page is after each.

An event waits in the state until the watermark has passed it, so that
missing predecessors can come first.  Then the page's events go out by
(time, kind, number): revisions (kind 0) before votes (kind 1) of the same time.  An event
that comes after the watermark is dropped by Spark and counted in the query's progress (``late_events``); one that is
in time, but behind what the page has already told, counts as ``n_late`` of its page.  A page that is idle for ``idle_ms``
of event time is forgotten.

State is read and written by batch, not by event: what a micro-batch brings for
an hour of a page is one value, and nothing is read before that hour is due; what it brings for a page, if it is little, is one
value of its first hour.  A page's events pass through memory hour by hour, some ``HELD_BYTES`` at a time.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import FRAME_WORDS, Edit, Page, Told, Trust, told_columns


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 90 * 86_400_000
SLOT_MICROS = 3_600_000_000
#: Bytes of one value of the state, and rows of one frame that goes out.
CHUNK_BYTES, FRAME_ROWS = 512 << 10, 10_000
#: Bytes of a page's events that are in memory at a time, and up to which a batch's events are one value.
HELD_BYTES, SLOT_BYTES = 16 << 20, 64 << 10
_ORDER = [("micros", "ascending"), ("kind", "ascending"), ("event", "ascending")]
_FED = "page string, event long, micros long, kind int, author long, place long, previous long, n_authors long, n_late long"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class OrderedEvents(StatefulProcessor):
    """Hands each page's due events in order to ``apply``; rows need event, micros and kind."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms, self.held_bytes, self.slot_bytes = idle_ms, HELD_BYTES, SLOT_BYTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long, part long", "rows binary")
        self.place = handle.getValueState("place", "place long, previous long, micros long, part long, n_late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, previous, done, part, late = self._where()
        first, tables, size = None, [], 0
        frames = (pa.Table.from_pandas(pdf, preserve_index=False) for pdf in rows)
        for frame in chain(frames, (None,)):
            if frame is not None:
                tables.append(frame)
                size += frame.nbytes
                if size < self.held_bytes:
                    continue
            if tables:
                new = pa.concat_tables(tables, promote_options="permissive")
                early = new["micros"].to_numpy() >= done if place else np.ones(len(new), bool)
                if early.any():
                    least = self._hold(new.filter(pa.array(early)), part)
                    first = least if first is None else min(first, least)
                part, late = part + 1, late + int((~early).sum())
            tables, size = [], 0
        if first is not None:  # one timer for the batch: when it fires, all that the watermark has passed goes out
            self.handle.registerTimer(first // 1000 + 1)
        self.place.update((place, previous, done, part, late))
        yield from ()

    def _hold(self, rows: pa.Table, part: int) -> int:
        """Rows as values of their hours, few rows as one value of the first hour; the earliest time."""
        micros = rows["micros"].to_numpy()
        slots = micros // SLOT_MICROS
        apart = rows.nbytes > self.slot_bytes
        for slot in np.unique(slots).tolist() if apart else [int(slots.min())]:
            self.held.updateValue((slot, part), (_packed(rows.filter(pa.array(slots == slot)) if apart else rows),))
        return int(micros.min())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        place, previous, done, part, late = self._where()
        keys = [tuple(k) for k in self.held.keys()]
        if not keys:
            if done // 1000 + self.idle_ms <= now:
                yield from self.end(key)
                for state in (self.place, self.held):
                    state.clear()
            return
        near = sorted(k for k in keys if k[0] * SLOT_MICROS // 1000 < now)
        waits = [k[0] * SLOT_MICROS // 1000 for k in keys if k[0] * SLOT_MICROS // 1000 >= now]
        tables, size, told = [], 0, False
        for k, following in zip(near, [*near[1:], None], strict=False):
            tables.append(_unpacked(self.held.getValue(k)[0]))
            self.held.removeKey(k)
            size += tables[-1].nbytes
            if following is not None and (size < self.held_bytes or following[0] == k[0]):
                continue
            rows = pa.concat_tables(tables, promote_options="permissive").sort_by(_ORDER)
            micros = rows["micros"].to_numpy()
            n = int(np.searchsorted(micros // 1000, now))
            if following is not None:  # what the values to come may hold waits for them
                n = min(n, int(np.searchsorted(micros, following[0] * SLOT_MICROS)))
            due, left = rows.slice(0, n), rows.slice(n)
            if n:
                yield from self.apply(key, due, place, previous if place else None, late)
                place, previous, done, told = place + n, due["event"][-1].as_py(), due["micros"][-1].as_py(), True
            tables, size = [left] if left.num_rows else [], 0
        for left in tables:
            waits.append(self._hold(left, part) // 1000)
        if near:
            self.place.update((place, previous, done, part + 1, late))
        if told:
            self.handle.registerTimer(done // 1000 + self.idle_ms)
        if waits:
            self.handle.registerTimer(max(min(waits), now) + 1)

    def _where(self) -> tuple[int, int, int, int, int]:
        return self.place.get() if self.place.exists() else (0, 0, 0, 0, 0)

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame(columns=[c.split()[0] for c in self.output.split(", ")])

    def apply(self, key, rows: pa.Table, place: int, previous: int | None, late: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def end(self, key) -> Iterator[pd.DataFrame]:
        """What is left to say of a page that is forgotten."""
        yield self.nothing()

    def close(self) -> None:
        pass


class PageFeed(OrderedEvents):
    """The events themselves, with their place, the event before and how many authors the page has had."""

    output = _FED
    #: Values that a page's authors are dealt into.
    SHARDS = 64

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.authors = handle.getMapState("authors", "shard int", "authors binary")
        self.n_authors = handle.getValueState("n_authors", "n long")

    def _first_seen(self, authors: np.ndarray) -> np.ndarray:
        """Which of these places name an author for the first time; they are noted."""
        names, at = np.unique(authors, return_index=True)
        fresh = np.zeros(len(authors), bool)
        shards = names % self.SHARDS
        for shard in np.unique(shards).tolist():
            own = shards == shard
            had = self.authors.getValue((shard,))
            known = np.frombuffer(had[0], np.int64) if had is not None else np.zeros(0, np.int64)
            new = own & ~np.isin(names, known)
            if new.any():
                fresh[at[new]] = True
                self.authors.updateValue((shard,), (np.concatenate((known, names[new])).tobytes(),))
        return fresh

    def apply(self, key, rows, place, previous, late):
        events = rows["event"].to_numpy()
        fresh = self._first_seen(rows["author"].to_numpy())
        n_before = self.n_authors.get()[0] if self.n_authors.exists() else 0
        before = pd.array([previous if previous is not None else pd.NA, *events[:-1].tolist()], "Int64")
        out = pd.DataFrame({"page": key[0], "event": events, "micros": rows["micros"].to_numpy(), "kind": rows["kind"].to_numpy(), "author": rows["author"].to_numpy(), "place": place + 1 + np.arange(len(events)), "previous": before, "n_authors": n_before + np.cumsum(fresh), "n_late": late})
        self.n_authors.update((int(n_before + fresh.sum()),))
        for at in range(0, len(out), FRAME_ROWS):
            yield out.iloc[at : at + FRAME_ROWS]

    def end(self, key):
        for state in (self.authors, self.n_authors):
            state.clear()
        yield self.nothing()


class PageHorizon(OrderedEvents):
    """Events with the sum and number of ``value`` over the page's last ``n`` events, themselves included."""

    output = "page string, event long, in_horizon double, n_horizon long"

    def __init__(self, n: int = 8, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "packed binary")

    def apply(self, key, rows, place, previous, late):
        had = np.frombuffer(bytes(self.last.get()[0]), float) if self.last.exists() else np.zeros(0)
        values = np.concatenate((had, rows["value"].to_numpy()))
        padded = np.concatenate((np.zeros(self.n - 1), values))
        sums = np.lib.stride_tricks.sliding_window_view(padded, self.n).sum(axis=1)[len(had) :]
        counts = np.minimum(np.arange(len(had) + 1, len(values) + 1), self.n)
        self.last.update((values[len(values) - min(len(values), self.n - 1) :].tobytes(),))
        out = pd.DataFrame({"page": key[0], "event": rows["event"].to_numpy(), "in_horizon": sums, "n_horizon": counts})
        for at in range(0, len(out), FRAME_ROWS):
            yield out.iloc[at : at + FRAME_ROWS]

    def end(self, key):
        self.last.clear()
        yield self.nothing()


class PageTrust(OrderedEvents):
    """The text of each revision with the trust of its words, as ``tracking.track_words`` tells it.

    The state holds the page's recent texts and deleted blocks, in values of a bounded size, read and
    written once for all events that are due.  Blocks age with the page and signatures go with the last text that has them.
    """

    output = "page string, revision long, author long, ts timestamp, n_new long, n_back long, words array<string>, origin array<long>, writer array<long>, lived array<int>, trust array<double>, signature array<long>, n_late long"

    def __init__(self, rule: Trust, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("page", "chunk int", "bytes binary")

    def _load(self) -> tuple[Page, int]:
        chunks = sorted((tuple(k)[0], bytes(tuple(v)[0])) for k, v in self.kept.iterator())
        return (Page.restored(self.rule, _unpacked(b"".join(c for _, c in chunks))), len(chunks)) if chunks else (Page(self.rule), 0)

    def _save(self, page: Page, before: int) -> None:
        data = _packed(page.stored())
        n = -(-len(data) // CHUNK_BYTES)
        for k in range(n):
            self.kept.updateValue((k,), (data[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES],))
        for k in range(n, before):
            self.kept.removeKey((k,))

    def _frame(self, key, rows: list[Told], late: int) -> pd.DataFrame:
        return pd.DataFrame({"page": [key[0]] * len(rows), **told_columns(rows), "n_late": [late] * len(rows)})

    def apply(self, key, rows, place, previous, late):
        page, before = self._load()
        ready, waiting = [], 0
        for row in rows.to_pylist():
            words, sections, vote = row["words"] or [], row["sections"], row["kind"] == 1
            section = np.array(sections if sections is not None and len(sections) == len(words) else [0] * len(words), np.int64)
            settled = page.take(Edit(row["event"], row["author"], row["weight"], row["micros"], self.rule.reads, 0.0 if vote else self.rule.looks, vote), words, section)
            ready += settled
            waiting += sum(len(r.block.words) for r in settled)
            if waiting > FRAME_WORDS:
                yield self._frame(key, ready, late)
                ready, waiting = [], 0
        self._save(page, before)
        if ready:
            yield self._frame(key, ready, late)

    def end(self, key):
        page, _ = self._load()
        self.kept.clear()
        yield self._frame(key, page.rest(), 0) if page.rest() else self.nothing()


def _events(events: DataFrame, delay: str, *more: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    own = [F.col("kind").cast("int").alias("kind"), F.coalesce("author", F.lit(0)).cast("long").alias("author")]
    return events.select("page", "event", ts.alias("ts"), F.unix_micros(ts).alias("micros"), *own, *more).withWatermark("ts", delay)


def late_events(query) -> int:
    """Events that a running or ended query has dropped for coming after the watermark, as far as it keeps its progress."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


def page_feed(events: DataFrame, delay: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of (page, event, ts, kind, author) in the order of each page, with the page's running state after each event."""
    feed = _events(events, delay).groupBy("page").transformWithStateInPandas(PageFeed(idle_ms), _FED, "Append", "EventTime")
    return feed.withColumn("ts", F.timestamp_micros("micros")).drop("micros")


def page_horizon(events: DataFrame, n: int = 8, delay: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of (page, event, ts, kind, author, value) with sums over the last ``n`` events of each page, in order."""
    rows = events.select("page", "event", "ts", "kind", "author", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    return _events(rows, delay, "value").groupBy("page").transformWithStateInPandas(PageHorizon(n, idle_ms), PageHorizon.output, "Append", "EventTime")


def page_trust(events: DataFrame, rule: Trust, delay: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of (page, event, ts, kind, author, weight, words, and sections if there are any) as revisions with their words' trust.

    ``kind`` 1 is a vote for the page's text as it is.
    """
    sections = F.col("sections").cast("array<long>") if "sections" in events.columns else F.lit(None).cast("array<long>").alias("sections")
    rows = events.select("page", "event", "ts", "kind", "author", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), "words", sections.alias("sections"))
    fed = _events(rows, delay, "weight", "words", "sections")
    return fed.groupBy("page").transformWithStateInPandas(PageTrust(rule, idle_ms), PageTrust.output, "Append", "EventTime")
