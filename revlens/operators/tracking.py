"""Words through the history of their page: where they come from, how long they live and how far they are trusted.

A page's revisions pass in order through one task, which holds the page's
recent texts and deleted blocks, never its history; pages are dealt out by key.
``Page`` is what is kept of a page between two revisions; ``streaming.pages``
keeps the same in a state store.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import read_share
from .diff import edit_distance, edit_list, tracked

_WORDS = "words array<string>, origin array<long>, writer array<long>, lived array<int>, trust array<double>, signature array<long>"
_OUT = "page {page}, revision long, author long, ts timestamp, n_new long, n_back long, " + _WORDS
#: Words that one frame of the fold's output holds at least before it goes out.
FRAME_WORDS = 50_000


@dataclass(frozen=True)
class Trust:
    """How trust moves.

    ``kind`` "classic" goes by cuts and reading alone; "sections" has the
    author look at the sections that the edit touches; "signed" also lets each author raise a word once, as long as the
    word's signature keeps their number.
    """

    kind: str = "classic"
    # What an author's weight lends to new text, how far a cut reaches, what reading all and reading a looked-at
    # section raise, what deleting lowers, and how looking fades by words.
    lends: float = 0.3
    reads: float = 0.10
    looks: float = 0.18
    radius: float = 2.0
    kills: float = math.log(2) / 9
    fades: float = 0.5 ** (1 / 10)
    #: Deleted blocks are kept for so many revisions or days, whichever lasts longer, and so many words a page.
    dead_revisions: int = 100
    dead_days: float = 90.0
    dead_words: int = 10_000
    #: A revision is compared with so many before it.  If one is closer than the last, the text was taken back: its words come from that one.
    recents: int = 1
    #: Whether the trust of words rises in the recent revisions too that have them; these are told once they are recent no more.
    percolates: bool = False

    @classmethod
    def batch(cls, **own) -> Trust:
        """Deleted blocks as batch runs keep them: up to 25 revisions or 10 days, however many words."""
        return cls(**{"dead_revisions": 26, "dead_days": 10.0, "dead_words": 1 << 40, **own})


@dataclass
class _Block:
    """A stretch of words with the columns that each word carries."""

    words: list
    origin: np.ndarray
    writer: np.ndarray
    lived: np.ndarray
    trust: np.ndarray
    signature: np.ndarray
    since: tuple[int, float] = (0, 0.0)  # for a deleted block: revision count and time of its deletion

    def cut(self, a: int, b: int) -> _Block:
        return _Block(self.words[a:b], self.origin[a:b], self.writer[a:b], self.lived[a:b], self.trust[a:b], self.signature[a:b], self.since)


@dataclass(frozen=True)
class Edit:
    """Who makes a revision, and how much of the page they read."""

    revision: int
    author: int
    weight: float
    micros: int
    reads: float
    looks: float
    vote: bool = False
    robot: bool = False


@dataclass
class Told:
    """A revision's row: the text it leaves, and how many of its words are new and came back."""

    revision: int
    author: int
    micros: int
    new: int
    back: int
    block: _Block
    text: str | None = None


def author_number(author: int, word: str) -> int:
    """An author's number in a word's signature, as ``functions.text.author_hash`` has it."""
    return zlib.crc32(f"{author} {word}".encode()) % 1023 + 1


def _author_numbers(author: int, words: list) -> np.ndarray:
    """``author_number`` of each word."""
    start = zlib.crc32(f"{author} ".encode())
    known = {w: zlib.crc32(w.encode(), start) % 1023 + 1 for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _signed_by(signatures: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([(signatures >> (10 * i)) & 1023 == numbers for i in range(3)])


def _ahead(section: np.ndarray, at: int, stop: int, step: int) -> np.ndarray:
    """The places from ``at`` on, in steps, before ``stop`` and within one section."""
    places = np.arange(at, stop, step)
    other = np.flatnonzero(section[places] != section[at])
    return places[: other[0]] if len(other) else places


def _section_trust(trust: np.ndarray, may: np.ndarray, inserted: np.ndarray, section: np.ndarray, moves: list, n_old: int, edit: Edit, rule: Trust) -> tuple[np.ndarray, np.ndarray]:
    """(trust, raised): the live words' trust after an edit.

    Trust may fall anywhere, and rise where ``may`` is true.  Cuts draw the
    words up to the section's end towards what new text has; a cut against an
    insertion of two words or more in another section is none.  What the
    author looked at, then all words, rise towards the author's weight; where they may not, words end no
    lower than new text.
    """
    n, new = len(trust), edit.weight * rule.lends
    looked, raised = inserted.copy(), inserted.copy()
    # lengths of insertions by their ends
    begins = {j: l for kind, _, _, j, _, l in moves if kind == "ins"}
    ends = {j + l: l for kind, _, _, j, _, l in moves if kind == "ins"}

    def look(at: int) -> None:
        if not looked[at]:
            for places in (_ahead(section, at, n, 1), _ahead(section, at, -1, -1)):
                met = np.flatnonzero(looked[places][1:])
                looked[places[: met[0] + 1] if len(met) else places] = True

    def draw(places: np.ndarray) -> None:
        drawn = trust[places] + (new - trust[places]) * np.exp(-np.arange(len(places)) / rule.radius)
        up = (drawn > trust[places]) & may[places]
        raised[places[up]] = True
        trust[places] = np.where(up | (drawn <= trust[places]), drawn, trust[places])

    for kind, i, c, j, d, l in moves:
        if kind != "mov" or d != 0:
            continue
        last = j + l - 1
        if (i, j, c) != (0, 0, 0) and (j == 0 or section[j] == section[j - 1] or ends.get(j, 0) < 2):
            look(j)
            draw(_ahead(section, j, last + 1, 1))
        if (i + l != n_old or j + l != n or c) and (last == n - 1 or section[last] == section[last + 1] or begins.get(last + 1, 0) < 2):
            look(last)
            draw(_ahead(section, last, j - 1, -1))
    since = np.arange(n) - np.maximum.accumulate(np.where(looked, np.arange(n), -1))
    spread = np.where(np.logical_or.accumulate(looked), rule.fades**since, 0.0)
    spread = spread + (1 - spread) * rule.fades  # backwards every word counts as one step away
    for share in (edit.looks * spread, np.full(n, edit.reads)):
        up = (trust < edit.weight) & may
        trust = np.where(up, trust + (edit.weight - trust) * share, trust)
        raised |= up
    return np.where(~may & (trust < new) & (trust < edit.weight), new, trust), raised


def _moved_trust(old: np.ndarray, edit: Edit, rule: Trust, was_live: bool, at_start: bool, at_end: bool) -> np.ndarray:
    """Close to a cut a word's trust goes towards what its author lends; then reading raises what is below the author's weight."""
    n = len(old)
    far = np.full(n, np.inf)
    left = far if was_live and at_start else np.arange(n)
    right = far if was_live and at_end else np.arange(n)[::-1]
    near_cut = np.exp(-np.minimum(left, right) / rule.radius)
    trust = old + (edit.weight * rule.lends - old) * near_cut
    return np.where(edit.weight > trust, trust + (edit.weight - trust) * edit.reads, trust)


def _followed(blocks: list[_Block], words: list, section: np.ndarray, edit: Edit, at: tuple[int, float], rule: Trust) -> tuple[_Block, list[_Block], int, int]:
    """The live text after a revision, the deleted blocks, and how many words are new and came back."""
    texts, moves = tracked([b.words for b in blocks], words)
    n, n_old = len(words), len(blocks[0].words)
    live = _Block(list(words), np.full(n, edit.revision), np.full(n, edit.author), np.zeros(n, np.int64), np.full(n, edit.weight * rule.lends), np.zeros(n, np.int64))
    inserted, back = np.ones(n, bool), 0
    dead: dict[int, _Block] = {}
    for kind, i, c, j, d, l in moves:
        if kind != "mov":
            continue
        source = blocks[c].cut(i, i + l)
        if d == 0:
            here = slice(j, j + l)
            inserted[here] = False
            live.origin[here], live.writer[here], live.lived[here], live.signature[here] = source.origin, source.writer, source.lived + 1, source.signature
            live.trust[here] = source.trust if rule.kind != "classic" else _moved_trust(source.trust, edit, rule, c == 0, i == 0 and j == 0, i + l == n_old and j + l == n)
            back += l if c else 0
        else:
            dead[d] = source
            if c == 0:
                source.trust = source.trust * math.exp(-edit.weight * rule.kills)
                source.since = at
    if rule.kind != "classic" and n:
        numbers = _author_numbers(edit.author, words) if rule.kind == "signed" else np.zeros(n, np.int64)
        may = inserted | ((edit.author != 0) & ~_signed_by(live.signature, numbers)) if rule.kind == "signed" else np.ones(n, bool)
        live.trust, raised = _section_trust(live.trust, may, inserted, section, moves, n_old, edit, rule)
        if rule.kind == "signed" and edit.author:
            add = raised & ~_signed_by(live.signature, numbers)
            live.signature = np.where(add, numbers | (live.signature & 0xFFFFF) << 10, live.signature)
    return live, [dead[d] for d in range(1, len(texts))], sum(m[5] for m in moves if m[0] == "ins"), back


def _young(dead: list[_Block], at: tuple[int, float], rule: Trust) -> list[_Block]:
    """The deleted blocks that are kept, cut where the page's room for them ends."""
    kept, room = [], rule.dead_words
    for block in dead:
        young = at[0] - block.since[0] < rule.dead_revisions or at[1] - block.since[1] < rule.dead_days * 86400
        if young and room > 0:
            kept.append(block.cut(0, room))
            room -= len(kept[-1].words)
    return kept


def _empty() -> _Block:
    none = np.zeros(0, np.int64)
    return _Block([], none, none, none, np.zeros(0), none)


class Page:
    """What is kept of a page between its revisions: the recent ones, the last first, its deleted blocks and their number so far."""

    def __init__(self, rule: Trust):
        self.rule, self.count = rule, 0
        self.recent: list[Told] = []
        self.dead: list[_Block] = []
        self.section = np.zeros(0, np.int64)

    def take(self, edit: Edit, words: list, section: np.ndarray, text: str | None = None) -> list[Told]:
        """The rows that a revision or vote settles."""
        rule, at = self.rule, (self.count, edit.micros / 1e6)
        live = self.recent[0].block if self.recent else _empty()
        if edit.vote:
            block, _, _, _ = _followed([live], live.words, self.section, edit, at, rule)
            if self.recent:
                self.recent[0] = replace(self.recent[0], block=block)
            return [Told(edit.revision, edit.author, edit.micros, 0, 0, block, self.recent[0].text if self.recent else None)]
        self.section = section
        block, dead, new, back = _followed([live, *self.dead], words, section, edit, at, rule)
        compared = self.recent[: rule.recents] if rule.recents > 1 else []
        lists = [edit_list(told.block.words, words) for told in compared]
        far = [edit_distance(edits, max(len(told.block.words), len(words))) for told, edits in zip(compared, lists, strict=True)]
        if far and min(far) < far[0]:
            closest = far.index(min(far))  # the later of equals
            other, _, _, _ = _followed([compared[closest].block, live, *self.dead], words, section, edit, at, rule)
            more = other.trust > block.trust
            block = _Block(block.words, other.origin, other.writer, other.lived, np.where(more, other.trust, block.trust), np.where(more, other.signature, block.signature))
        self.dead = _young(dead, at, rule)
        self.count += 1
        if rule.percolates and not edit.robot:
            for told, edits in zip(compared, lists, strict=True):
                told.block = _percolated(told.block, block, edits)
        row = Told(edit.revision, edit.author, edit.micros, new, back, block, text)
        self.recent.insert(0, row)
        settled = self.recent[max(rule.recents, 1) :]
        del self.recent[max(rule.recents, 1) :]
        return settled if rule.percolates else [row]

    def stored(self) -> pa.Table:
        """The page as a table, a row for each recent revision and each deleted block."""
        told = [*self.recent, *[Told(0, 0, 0, 0, 0, b) for b in self.dead]]
        fields = {"dead": [False] * len(self.recent) + [True] * len(self.dead), **{c: [getattr(t, c) for t in told] for c in ("revision", "author", "micros", "new", "back", "text")}}
        fields |= {"since_count": [t.block.since[0] for t in told], "since_seconds": [float(t.block.since[1]) for t in told]}
        fields |= {c: [getattr(t.block, c) for t in told] for c in ("words", "origin", "writer", "lived", "trust", "signature")}
        fields["section"] = [self.section if k == 0 else None for k in range(len(told))]
        return pa.Table.from_pydict(fields, _STORED.with_metadata({"count": str(self.count)}))

    @classmethod
    def restored(cls, rule: Trust, table: pa.Table) -> Page:
        page = cls(rule)
        page.count = int(table.schema.metadata[b"count"])
        for row in table.to_pylist():
            arrays = [np.array(row[c], float if c == "trust" else np.int64) for c in ("origin", "writer", "lived", "trust", "signature")]
            block = _Block(row["words"], *arrays, (row["since_count"], row["since_seconds"]))
            if row["dead"]:
                page.dead.append(block)
            else:
                page.recent.append(Told(*[row[c] for c in ("revision", "author", "micros", "new", "back")], block, row["text"]))
            if row["section"] is not None:
                page.section = np.array(row["section"], np.int64)
        return page

    def rest(self) -> list[Told]:
        """The rows that no further revision will settle, the earliest first."""
        return self.recent[::-1] if self.rule.percolates else []


_NUMBERS = pa.list_(pa.int64())
_STORED = pa.schema(
    [("dead", pa.bool_()), *[(c, pa.int64()) for c in ("revision", "author", "micros", "new", "back")], ("text", pa.string()), ("since_count", pa.int64()), ("since_seconds", pa.float64())]
    + [("words", pa.list_(pa.string())), ("origin", _NUMBERS), ("writer", _NUMBERS), ("lived", _NUMBERS), ("trust", pa.list_(pa.float64())), ("signature", _NUMBERS), ("section", _NUMBERS)]
)


def _percolated(older: _Block, newer: _Block, edits: list) -> _Block:
    """The older text, with its words trusted at least as what became of them."""
    trust = older.trust.copy()
    for kind, i, j, l in edits:
        if kind == "mov":
            trust[i : i + l] = np.maximum(trust[i : i + l], newer.trust[j : j + l])
    return replace(older, trust=trust)


def told_columns(rows: list[Told]) -> dict[str, list]:
    blocks = [r.block for r in rows]
    head = {"revision": [r.revision for r in rows], "author": [r.author for r in rows], "ts": pd.to_datetime([r.micros for r in rows], unit="us"), "n_new": [r.new for r in rows], "n_back": [r.back for r in rows]}
    return {**head, **{c: [getattr(b, c) for b in blocks] for c in ("words", "origin", "writer", "lived", "trust", "signature")}}


_GIVEN = ("page", "revision", "author", "ts", "weight", "words", "sections", "vote", "robot", "reads", "looks", "text")


def _fold(batches: Iterator[pd.DataFrame], rule: Trust) -> Iterator[pd.DataFrame]:
    name, page = None, None
    ready: list[tuple] = []  # (page's key, row)
    waiting = 0

    def frame() -> pd.DataFrame:
        columns = told_columns([r for _, r in ready])
        return pd.DataFrame({"page": [p for p, _ in ready], **columns, "text": [r.text for _, r in ready]})

    for pdf in batches:
        for p, revision, author, ts, weight, words, sections, vote, robot, reads, looks, text in zip(*(pdf[c] for c in _GIVEN), strict=True):
            if page is None or p != name:
                ready += [(name, r) for r in page.rest()] if page is not None else []
                name, page = p, Page(rule)
            words = list(words) if words is not None else []
            section = np.asarray(sections, np.int64) if sections is not None and len(sections) == len(words) else np.zeros(len(words), np.int64)
            edit = Edit(int(revision), int(author), float(weight), ts.value // 1000, float(reads), 0.0 if vote else float(looks), bool(vote), bool(robot))
            settled = page.take(edit, words, section, text)
            ready += [(name, r) for r in settled]
            waiting += sum(len(r.block.words) for r in settled)
            if waiting > FRAME_WORDS or len(ready) > FRAME_WORDS // 10:
                yield frame()
                ready, waiting = [], 0
    if page is not None:
        ready += [(name, r) for r in page.rest()]
    if ready:
        yield frame()


def track_words(revs: DataFrame, order: list[str], rule: Trust = Trust()) -> DataFrame:
    """For each revision its words with the revision and author each comes from, the revisions it lived through, its trust and signature.

    ``revs`` has page, revision, author (0: anonymous), ts, weight (of the
    author's reputation) and words; a null list is an empty text.  It may have sections
    (a number for each word), reads and looks (instead of the rule's, as
    ``functions.text.read_share`` gives them), vote: a row that votes for the page's text as it is has no words of its own,
    robot: a revision whose trust does not percolate, and text, which is handed on.
    """
    given = lambda c, of, other: (F.coalesce(F.col(c).cast(of), F.lit(other)) if c in revs.columns else F.lit(other).cast(of)).alias(c)
    rows = revs.select(
        "page", F.col("revision").cast("long").alias("revision"), F.coalesce("author", F.lit(0)).cast("long").alias("author"), "ts", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), "words",
        (F.col("sections") if "sections" in revs.columns else F.lit(None)).cast("array<int>").alias("sections"), given("vote", "boolean", False), given("robot", "boolean", False), given("reads", "double", rule.reads), given("looks", "double", rule.looks), given("text", "string", None),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.repartition("page").sortWithinPartitions("page", *keys).drop(*keys)
    told = dealt.mapInPandas(lambda it: _fold(it, rule), _OUT.format(page=dict(rows.dtypes)["page"]) + ", text string")
    return told if "text" in revs.columns else told.drop("text")


def timed_reads(revs: DataFrame, order: list[str], rule: Trust = Trust(), seconds: float = 86400.0, on_line: bool = True) -> DataFrame:
    """``revs`` with reads and looks by the time since the revision before: who comes soon reads less; robots (column robot, if any) read nothing.

    Not ``on_line``, shares grow in proportion, as local and batch runs have them; a page's first revision is read in full.
    """
    passed = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("page").orderBy(*order)))
    robot = F.coalesce("robot", F.lit(False)) if "robot" in revs.columns else F.lit(False)
    told = revs.withColumn("_passed", passed)
    later = F.greatest(F.col("_passed"), F.lit(0))
    share = lambda base: F.when(F.col("_passed").isNull() & ~robot, base).otherwise(read_share(F.lit(base), later, seconds, robot, on_line))
    return told.withColumns({"reads": share(rule.reads), "looks": share(rule.looks)}).drop("_passed")


def words_by_author(told: DataFrame) -> DataFrame:
    """New words by author, the most first."""
    return told.groupBy("author").agg(F.sum("n_new").alias("words")).orderBy(F.desc("words"), "author")


def contribution(told: DataFrame, order: list[str], end) -> DataFrame:
    """Days for which each author's words were on display, summed over words; the last revision stays until ``end``."""
    until = F.coalesce(F.lead("ts").over(Window.partitionBy("page").orderBy(*order)), end)
    days = told.withColumn("days", (F.unix_timestamp(until) - F.unix_timestamp("ts")) / 86400)
    shown = days.select(F.explode("writer").alias("author"), "days")
    return shown.groupBy("author").agg(F.sum("days").alias("word_days"))


def coloured(told: DataFrame) -> DataFrame:
    """(page, revision, text): the words, with a mark ``{{#t:trust,origin,author}}`` wherever one of the three changes."""
    one = F.arrays_zip("words", "shown", "origin", "writer")
    same = lambda a, b: (a["shown"] == b["shown"]) & (a["origin"] == b["origin"]) & (a["writer"] == b["writer"])
    mark = lambda x: F.format_string("{{#t:%d,%d,%d}}", x["shown"], x["origin"], x["writer"])
    shown = F.transform("w", lambda x, i: F.when((i > 0) & same(x, F.get("w", F.greatest(i - 1, F.lit(0)))), x["words"]).otherwise(F.concat(mark(x), x["words"])))
    return told.withColumn("shown", F.transform("trust", lambda t: F.round(t).cast("int"))).withColumn("w", one).select("page", "revision", F.array_join(shown, " ").alias("text"))


def percolated(older: DataFrame, newer: DataFrame, moves: DataFrame) -> DataFrame:
    """Trust of older words raised to that of the newer words they became.

    ``older`` and ``newer`` have (pair, at, trust), ``moves`` the edits of the pair.
    """
    same = moves.where("kind = 'mov'").select("pair", F.col("i"), F.explode(F.sequence(F.lit(0), F.col("l") - 1)).alias("k"), "j")
    told = same.select("pair", (F.col("i") + F.col("k")).alias("at"), (F.col("j") + F.col("k")).alias("to"))
    later = told.join(newer.select("pair", F.col("at").alias("to"), F.col("trust").alias("_new")), ["pair", "to"]).groupBy("pair", "at").agg(F.max("_new").alias("_new"))
    return older.join(later, ["pair", "at"], "left").select("pair", "at", F.greatest("trust", F.coalesce("_new", "trust")).alias("trust"))
