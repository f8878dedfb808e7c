"""Benchmark passages in documents, by one Aho-Corasick automaton.

The symbols of the automaton are words: texts are normalised (capitals A-Z
lowered, all other ASCII but digits a gap), an item's windows of
``WINDOW`` words become sequences of word numbers, and a document is read
once, word by word, through the automaton; words that no item has are the
number 0 and lead back to its root.  Matches are intervals of words;
where a document has any, they are mapped back to code points of the
original text.

A benchmark is cut into pieces of at most ``PIECE`` windows, dealt into blocks
of some ``BLOCK_WORDS`` words; a block's automaton is what every task holds.  The
blocks are counted before any is sent, and their number is doubled while one is
too large.  With several blocks the documents pass through one automaton
after the other, written in between; nothing is dropped.

Null and empty texts have no words and no hits.  Items of fewer words than a
window are one window; items without words are none.  Items that share a
window are all named.  Rows of items that repeat an id count once; a row
without an id marks words but is not named.  Rows of documents are each judged by
themselves.  Extra columns are ignored.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_texts
from .merkle_manifest import lower_ascii

WINDOW = 10
PIECE = 1_000
BLOCK_WORDS = 200_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STATE = "doc_id long, text string, marks array<struct<start:int,stop:int>>, item_ids array<long>"
_FOUND = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,stop:long>>"


def pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item_id, words): the words of at most ``piece`` windows that follow each other in an item."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_ITEM_WORDS), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)), F.lit(piece))
    return items.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(piece + window - 1)).alias("words")).distinct()


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The pieces of one block after the other, each of at most twice ``block_words`` words or a single piece."""
    cutup = cut(pieces(benchmark, window, min(PIECE, block_words)))
    total = cutup.agg(F.sum(F.size("words"))).first()[0] or 0
    number = max(1, -(-total // block_words))
    own = lambda: F.pmod(F.xxhash64("item_id", "words"), F.lit(number))
    while number < total:
        largest = cutup.groupBy(own().alias("block")).agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("rows")).agg(F.max(F.when(F.col("rows") > 1, F.col("n")))).first()[0] or 0
        if largest <= 2 * block_words:
            break
        number *= 2
    for b in range(number):
        yield [(row["item_id"], row["words"]) for row in cutup.where(own() == b).collect()]


class Automaton:
    """The windows of a block as sequences of word numbers; built once in a worker."""

    def __init__(self, block: list[tuple[int | None, list[str]]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set] = {}
        for item, words in block:
            numbered = tuple(self.numbers.setdefault(w.encode(), len(self.numbers) + 1) for w in words)
            for at in range(max(1, len(numbered) - window + 1)):
                patterns.setdefault(numbered[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for sequence, items in patterns.items():
            self.automaton.add_word(sequence, (len(sequence), items - {None}))
        self.found = bool(patterns)
        if self.found:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Joined intervals of words inside a window, in order, and the items that have one."""
        marks: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.found:
            number = self.numbers.get
            for last, (size, named) in self.automaton.iter(tuple([number(w, 0) for w in words])):
                start = last + 1 - size
                items |= named
                while marks and marks[-1][1] >= start:  # a longer window may end where shorter ones lie apart
                    start = min(start, marks.pop()[0])
                marks.append((start, last + 1))
        return marks, items


_BUILT: dict[int, Automaton] = {}


def _automaton(sent, window: int) -> Automaton:
    if sent.id not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.id] = Automaton(sent.value, window)
    return _BUILT[sent.id]


class _Sent:
    """A broadcast block and its number, by which a worker knows the automaton that it has built."""

    def __init__(self, spark, block):
        self.broadcast = spark.sparkContext.broadcast(block)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _joined(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(marks):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _read(batch: pa.RecordBatch, automaton: Automaton) -> Iterator[tuple[str, int, list, list]]:
    """(text, number of words, intervals, items) of each row, with what former blocks found."""
    texts = batch["text"].to_pylist()
    former = zip(batch["marks"].to_pylist(), batch["item_ids"].to_pylist(), strict=True) if "marks" in batch.schema.names else [((), ())] * len(texts)
    for text, (had, items) in zip(texts, former, strict=True):
        words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower())
        marks, named = automaton.hits(words)
        if had:
            marks = _joined([(m["start"], m["stop"]) for m in had] + marks)
        yield text, len(words), marks, sorted(named.union(items))


def _pairs(rows: list[list[tuple[int, int]]], kind: pa.DataType) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in row] for row in rows], pa.list_(pa.struct([("start", kind), ("stop", kind)])))


def _carried(batches: Iterator[pa.RecordBatch], sent: _Sent, window: int) -> Iterator[pa.RecordBatch]:
    for batch in (b for b in batches if b.num_rows):
        _, _, marks, items = zip(*_read(batch, _automaton(sent, window)), strict=True)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], _pairs(marks, pa.int32()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text", "marks", "item_ids"])


def _finished(batches: Iterator[pa.RecordBatch], sent: _Sent, window: int) -> Iterator[pa.RecordBatch]:
    for batch in (b for b in batches if b.num_rows):
        texts, sizes, marks, items = zip(*_read(batch, _automaton(sent, window)), strict=True)
        hit = [sum(b - a for a, b in m) for m in marks]
        spans = [original_spans(t, m) for t, m in zip(texts, marks, strict=True)]
        columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), _pairs(spans, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "spans"])


def original_spans(text: str, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points, end exclusive, of intervals of words in ``text``."""
    if not marks:
        return []
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORDS.finditer(data.lower())]
    edges = [e for a, b in marks for e in (at[a][0], at[b - 1][1])]
    places = list(accumulate(len(data[a:b].decode("utf-8", "surrogatepass")) for a, b in zip([0, *edges], edges, strict=False)))
    return list(zip(places[::2], places[1::2], strict=True))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (ascending) and the spans of hit words in the original text, of every document."""
    spark = docs.sparkSession
    state, former = doc_texts(docs), None
    for block in blocks(benchmark, window, block_words):
        if former is not None:
            state = cut(state.mapInArrow(lambda it, sent=former: _carried(it, sent, window), _STATE))
        former = _Sent(spark, block)
    return state.mapInArrow(lambda it: _finished(it, former, window), _FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_contamination(docs, benchmark)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
