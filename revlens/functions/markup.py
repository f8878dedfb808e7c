"""Words of wiki markup: what a reader sees, each with the trust, origin and author that marks in the text give it.

``wiki_words`` is one pass over a column, a batch at a time: atomic tags are
cut out first, then each further kind of markup splits what is still plain.
Lengths count code points.  Time grows with the length of a text, whatever it holds.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import by_slices

# The longest text that ``wiki_words`` reads unless told otherwise, brackets or tags looked at for one opening, blocks of long texts, long plain stretches, pieces made into a column at a time, and the markup.
MOST_CHARS, MOST_LOOKS = 1_000_000, 20
BLOCK_CHARS, BLOCK_LOOKS = 100_000, 1_000
STRETCH_CHARS, RUN_PIECES = 200_000, 50_000
_OPENING = re.compile(r"\[\[|\[https?:|\{\{|#REDIRECT |<([a-zA-Z1-9_]+)[^>]*>", re.IGNORECASE)
#: Behind the last ``>`` no tag opens.
_LATE_OPENING = re.compile(r"\[\[|\[https?:|\{\{|#REDIRECT |(?!)()", re.IGNORECASE)
_CLOSES = {
    "[[": (re.compile(r"\[\[|#REDIRECT |\]\]", re.IGNORECASE), "]]"),
    "#redirect ": (re.compile(r"\[\[|#REDIRECT |\]\]", re.IGNORECASE), "]]"),
    "[http:": (re.compile(r"\[https?:|\]"), "]"),
    "[https:": (re.compile(r"\[https?:|\]"), "]"),
    "{{": (re.compile(r"\{\{|\}\}"), "}}"),
}
_CLOSING_TAG = re.compile(r"</([a-zA-Z1-9_]+) *>")
_MARK = "{{#t:"
_TITLES = re.compile(r"(?P<title_start>\n=+)|(?P<title_end>(?<!=)=++[ \t]*+(?=\n|\Z))|(?P<par_break>\n(?:----+)?[ \t]*(?=\n|\Z))")
_LINES = re.compile(r"(?P<bullet>\n[*#:;]+ *)|(?P<indent>\n +)|(?P<table_line>\n\{\|[^\n]*|\n\|\}|\n\|-[^\n]*)|(?P<table_caption>\n\|\+ *)")
_CELL = re.compile(r"\n[|!]|\|\||!!")
_BAR = re.compile(r"[|\n]")
_SPACES = re.compile(r"(?P<space>[,;.: \t][,;.: \n\t]*)|(?P<newline>\n[,;.: \n\t]*)|(?P<quotes>''+)|(?P<entity>&(?:amp;)?#?[a-zA-Z0-9]+;)")
#: What parts plain words; an entity is a word itself.
_BETWEEN = re.compile(r"[,;.: \t][,;.: \n\t]*|\n[,;.: \n\t]*|''+|(&(?:amp;)?#?[a-zA-Z0-9]+;)")
_ENTITIES = (("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Where a long plain stretch can be cut: no word, entity, blanks or quotes go on there.
_SEAM = re.compile(r"[, \n\t](?=[^,;.: \n\t])")
_COMMENT_END = re.compile(r"--[ \n\t]*>")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PIECES = "array<struct<kind:string,text:string,word:string,trust:double,origin:long,author:string>>"
_FIELDS = [pa.field(name, kind) for name, kind in (("kind", pa.string()), ("text", pa.string()), ("word", pa.string()), ("trust", pa.float64()), ("origin", pa.int64()), ("author", pa.string()))]
Piece = tuple[str, str]


class _Ahead:
    """The next matches of a pattern from a place on that only moves forward; no stretch is searched for each opening anew."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.near, self.over = pattern, text, deque(), False

    def looks(self, at: int) -> Iterator[re.Match]:
        near, last = self.near, None
        while near and near[0].start() < at:
            last = near.popleft()
        if last is not None and last.end() > at:  # a match that began before leaves a part, which can match otherwise
            near.clear()
            self.over = False
        for k in range(MOST_LOOKS):
            if k == len(near):
                found = None if self.over else self.pattern.search(self.text, near[-1].end() if near else at)
                if found is None:
                    self.over = True
                    return
                near.append(found)
            yield near[k]


def _end_of_tag(opening: re.Match, closings: _Ahead) -> int:
    """Where the closing tag of the same name ends; without one the opening stands alone."""
    if opening.string[opening.end() - 2] == "/":
        return opening.end()
    return next((closing.end() for closing in closings.looks(opening.end()) if closing[1] == opening[1]), opening.end())


def _end_of_brackets(opening: re.Match, others: _Ahead, close: str) -> int | None:
    depth = int(opening[0].lower() != "#redirect ")
    for found in others.looks(opening.end()):
        depth += -1 if found[0] == close else 1
        if depth == 0:
            return found.end()
    return None


def _atoms(text: str) -> list[Piece]:
    """Tags, links and templates whole, marks, and the plain stretches between."""
    out, start, at, tags = [], 0, 0, text.rfind(">") + 1
    ahead = {pattern: _Ahead(pattern, text) for pattern in (_CLOSING_TAG, *(other for other, _ in _CLOSES.values()))}
    while opening := _OPENING.search(text, at, tags) or _LATE_OPENING.search(text, max(at, tags)):
        if opening[1]:
            end = _end_of_tag(opening, ahead[_CLOSING_TAG])
        else:
            other, close = _CLOSES[opening[0].lower()]
            end = _end_of_brackets(opening, ahead[other], close)
        if end is None:
            at = opening.end()
            continue
        whole = text[opening.start() : end]
        kind = "mark" if whole.startswith(_MARK) else "redirect" if opening[0].lower() == "#redirect " else "tag"
        out += [("plain", text[start : opening.start()]), (kind, whole)]
        start = at = end
    return [p for p in (*out, ("plain", text[start:])) if p[1]]


def _without_marks(pieces: list[Piece]) -> tuple[list[Piece], list[tuple[int, str]]]:
    """The pieces without marks, which part no markup, and the marks with their places."""
    out: list[Piece] = []
    plain: list[str] = []
    marks, at = [], 0
    for kind, text in (*pieces, ("", "")):
        if kind == "mark":
            marks.append((at, text))
            continue
        at += len(text)
        if kind == "plain":
            plain.append(text)
            continue
        if plain:
            out.append(("plain", "".join(plain)))
            plain = []
        out.append((kind, text))
    return out[:-1], marks


def _with_marks(pieces: Iterable[Piece], marks: list[tuple[int, str]]) -> Iterator[Piece]:
    """The marks at their places again: within a word they part it, within markup they follow it."""
    start = at = k = 0
    for kind, text in pieces:
        end = start + len(text)
        while k < len(marks) and (marks[k][0] <= at or kind == "plain" and marks[k][0] < end):
            place, mark = marks[k]
            if place > at:
                yield kind, text[at - start : place - start]
                at = place
            yield "mark", mark
            k += 1
        yield kind, text[at - start :]
        start = at = end
    for _, mark in marks[k:]:
        yield "mark", mark


def _cells(text: str) -> Iterator[tuple[str, int, int]]:
    """Starts of cells; each takes the modifiers with it that single bars end."""
    end, bar = 0, -1
    while cell := _CELL.search(text, end):
        end = cell.end()
        while True:
            if bar < end:  # the first bar or line's end from here on
                found = _BAR.search(text, end)
                bar = found.start() if found else len(text)
            if bar == end or not text.startswith("|", bar) or text.startswith("|", bar + 1):
                break
            end = bar + 1
        yield "table_cell", cell.start(), end


def _matches(markup: re.Pattern) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    return lambda text: ((found.lastgroup, *found.span()) for found in markup.finditer(text))


def _split(pieces: Iterable[Piece], markup: Callable[[str], Iterator[tuple[str, int, int]]]) -> Iterator[Piece]:
    """The pieces with the plain ones split by ``markup``: the (kind, start, end) of what it finds in a text."""
    for kind, text in pieces:
        if kind != "plain":
            yield kind, text
            continue
        at = 0
        for found, start, end in markup(text):
            if start > at:
                yield "plain", text[at:start]
            yield found, text[start:end]
            at = end
        if at < len(text):
            yield "plain", text[at:]


def _spaceless(text: str) -> str:
    text = re.sub("(?: \n\t)+", " ", text)
    return text[text.startswith(" ") : len(text) - (len(text) > 1 and text.endswith(" "))]


#: The visible word of each kind; kinds without one separate.
_WORDS = {
    "title_start": str,
    "title_end": lambda s: s.rstrip(" \t\n") + "\n",
    "bullet": lambda s: s.rstrip(" \t\n"),
    "indent": str,
    "table_line": _spaceless,
    "table_caption": lambda s: "\n|+",
    "table_cell": _spaceless,
    "tag": _spaceless,
    "redirect": _spaceless,
    "entity": str,
    "word": lambda s: s.removesuffix(s[-1] if s[-1] in ".:;," else "").translate(_LOWER),
}


def _disarmed(text: str) -> str:
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return text


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := _COMMENT_END.search(text, start + 4)):
        out.append(text[at:start])
        at = end.end()
    return "".join([*out, text[at:]])


def _line_pieces(text: str) -> tuple[Iterator[Piece], list[tuple[int, str]]]:
    """Tags, titles, lines and cells, the plain stretches between, and the marks with their places."""
    pieces, marks = _without_marks(_atoms("\n" + _without_comments(text)))
    for markup in (_matches(_TITLES), _matches(_LINES), _cells):
        pieces = _split(pieces, markup)
    return iter(pieces), marks


def _stretches(text: str) -> Iterator[str]:
    """A plain stretch in parts of some ``STRETCH_CHARS``, cut where nothing goes on."""
    start = 0
    while len(text) - start > STRETCH_CHARS and (seam := _SEAM.search(text, start + STRETCH_CHARS)):
        yield text[start : seam.end()]
        start = seam.end()
    yield text[start:]


def _visible(text: str, disarm: bool) -> list[str]:
    """The visible words of a text; plain stretches are parted in one go."""
    pieces, marks = _line_pieces(_disarmed(text) if disarm else text)
    if marks:  # they part words
        return [_WORDS[kind](piece) for kind, piece in _pieces(pieces, marks) if kind in _WORDS]
    out: list[str] = []
    for kind, whole in pieces:
        if kind != "plain":
            out += [_WORDS[kind](whole)] if kind in _WORDS else []
            continue
        for piece in _stretches(whole):
            parts = _BETWEEN.split(piece)
            plain = [p.lower() for p in parts[::2]] if piece.isascii() else [p.translate(_LOWER) for p in parts[::2]]
            if any(parts[1::2]):
                plain = [w for pair in zip(plain, [*parts[1::2], None], strict=True) for w in pair]
            out += filter(None, plain)
    return out


def _pieces(lines: Iterator[Piece], marks: list[tuple[int, str]]) -> Iterator[Piece]:
    """The pieces of ``_line_pieces`` with the plain ones split into words, spaces and marks."""
    pieces = _split(lines, _matches(_SPACES))
    pieces = _with_marks(pieces, marks) if marks else pieces
    first = next(pieces, ("newline", "\n"))
    for kind, text in pieces if first == ("newline", "\n") else chain((first,), pieces):
        if kind != "quotes":
            yield "word" if kind == "plain" else kind, text


def wiki_pieces(text: str, disarm: bool = True) -> list[Piece]:
    """The pieces of a text in order, as (kind, text); marks are kept, quotes dropped."""
    return list(_pieces(*_line_pieces(_disarmed(text) if disarm else text)))


def text_blocks(text: str) -> list[str]:
    """The strings that a long text is read as: some ``BLOCK_CHARS`` each, cut behind the first blank from there on if it is near.

    Words and markup never go across two of them.
    """
    out, start = [], 0
    while len(text) - start > BLOCK_CHARS:
        stop = start + BLOCK_CHARS
        blank = text.find(" ", stop, stop + BLOCK_LOOKS - 1)
        stop = blank + 1 if blank >= 0 else stop
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def block_pieces(text: str, disarm: bool = True) -> list[Piece]:
    """``wiki_pieces`` of each block of a text; only the first begins a line."""
    out: list[Piece] = []
    for k, block in enumerate(text_blocks(text)):
        pieces = wiki_pieces(block, disarm) if k == 0 else wiki_pieces("x" + block, disarm)
        if k:  # the letter kept the block from beginning a line
            kind, first = pieces[0]
            pieces[0:1] = [(kind, first[1:])] if len(first) > 1 else []
        out += pieces
    return out


def _mark(text: str) -> tuple[float, int, str]:
    """(trust, origin, author) of a mark; what is missing or no number is 0 or empty."""
    fields = [*text[len(_MARK) : -2].split(","), "", ""][:3]
    trust = float(fields[0]) if re.fullmatch(r"\d+\.?\d*(?:[eE][-+]?\d+)?", fields[0]) else 0.0
    return trust, int(fields[1]) if fields[1].isdigit() else 0, fields[2]


def _told(pieces: Iterable[Piece]) -> Iterator[tuple]:
    """The values of ``_FIELDS`` for each piece but the marks, which give them."""
    trust, origin, author = 0.0, 0, ""
    for kind, piece in pieces:
        if kind == "mark":
            trust, origin, author = _mark(piece)
            continue
        yield kind, piece, _WORDS[kind](piece) if kind in _WORDS else None, trust, origin, author


def _column(told: Iterable[Iterable[tuple]]) -> pa.Array:
    """The column of ``wiki_words`` with a list for each text; pieces are held in Python for a run at a time."""
    runs, ends, n, run = [], [0], 0, []

    def close() -> None:
        fields = zip(*run) if run else [()] * len(_FIELDS)
        runs.append(pa.StructArray.from_arrays([pa.array(values, field.type) for values, field in zip(fields, _FIELDS, strict=True)], fields=_FIELDS))
        run.clear()

    for rows in told:
        for row in rows:
            run.append(row)
            n += 1
            if len(run) == RUN_PIECES:
                close()
        ends.append(n)
    close()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(runs))


def wiki_words(text: Column, disarm: bool = True, blocks: bool = False, most: int | None = MOST_CHARS) -> Column:
    """Array of the pieces of a text: kind, text, the visible word (null for what only separates), trust, origin and author.

    With ``blocks`` long texts are read block by block, as ``text_blocks`` cuts them.  Without, a text of over ``most`` code points is
    taken for vandalism and has none; with None every text is read.
    """

    def told(text: str) -> Iterator[tuple]:
        if blocks:
            return _told(block_pieces(text, disarm))
        return _told(_pieces(*_line_pieces(_disarmed(text) if disarm else text)) if most is None or len(text) <= most else ())

    return by_slices(lambda texts: _column(told(t or "") for t in texts.to_pylist()), PIECES, text)


def visible_words(text: Column | str, disarm: bool = True, blocks: bool = False) -> Column:
    """Array of the visible words of a text alone, however long it is: those of ``wiki_words`` without what separates and marks them."""

    def words(texts: pa.Array) -> pa.Array:
        if blocks:
            told = [[_WORDS[kind](piece) for kind, piece in block_pieces(t or "", disarm) if kind in _WORDS] for t in texts.to_pylist()]
        else:
            told = [_visible(t or "", disarm) for t in texts.to_pylist()]
        return pa.array(told, pa.list_(pa.string()))

    return by_slices(words, "array<string>", text)


#: Markup that a mark follows in any case.
_LEADS = frozenset(("title_start", "bullet", "indent", "table_cell", "table_caption", "newline", "tag"))


def annotated(text: str, trust: list, origin: list, author: list, origins: bool = True, authors: bool = True, blocks: bool = False) -> str:
    """A text with a mark of trust, origin and author before a word wherever they change, on both sides of tags, and behind what begins a line or cell.

    The three lists have a value for each visible word; behind the last word marks repeat the last.
    """
    labels = [f"{_MARK}{int(t + 0.5)},{o if origins else ''},{a if authors else ''}}}}}" for t, o, a in zip(trust, origin, author, strict=True)]
    empty = f"{_MARK}0,{0 if origins else ''},}}}}"
    label = lambda k: labels[min(k, len(labels) - 1)] if labels else empty
    out, at, shown = [], 0, f"{_MARK}0,,}}}}"
    for kind, piece in (block_pieces if blocks else wiki_pieces)(text) if text else ():
        if kind == "mark":
            continue
        if kind == "tag" or kind == "word" and label(at) != shown:
            out.append(shown := label(at))
        out.append(piece)
        at += kind in _WORDS
        if kind in _LEADS:
            out.append(shown := label(at))
    return "".join(out)


def coloured_markup(text: Column | str, trust: Column | str, origin: Column | str, author: Column | str, origins: bool = True, authors: bool = True, blocks: bool = False) -> Column:
    """``annotated`` over columns: a tracked revision's text and its words' trust, origin and author."""

    def marked(*given: pa.Array) -> pa.Array:
        return pa.array([annotated(t or "", w, o, a, origins, authors, blocks) for t, w, o, a in zip(*[c.to_pylist() for c in given], strict=True)], pa.string())

    return by_slices(marked, "string", text, trust, origin, author)


def words_only(pieces: Column) -> Column:
    return F.transform(F.filter(pieces, lambda p: p["word"].isNotNull()), lambda p: p["word"])


def sections(pieces: DataFrame, key: str, pieces_column: str = "pieces") -> DataFrame:
    """(key, at, word, section): each word with the number of its section; titles, list items, table parts and empty lines part sections."""
    each = pieces.select(key, F.posexplode(pieces_column).alias("at", "p")).select(key, "at", "p.*")
    before = F.col("kind").isin("par_break", "title_start", "bullet", "indent", "table_cell", "table_line", "table_caption").cast("int")
    w = Window.partitionBy(key).orderBy("at")
    number = F.sum(before).over(w) + F.coalesce(F.sum((F.col("kind") == "title_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("section", number).where("word is not null").select(key, "at", "word", "section")


_STARTS = frozenset(("title_start", "bullet", "indent", "table_cell", "table_caption"))
_APART = frozenset(("newline", "par_break", "table_line", "tag", "redirect", "title_end"))


def _marked(pieces: pa.StructArray) -> Iterator[str]:
    last = ""
    for start in range(0, len(pieces), RUN_PIECES):
        run = pieces.slice(start, RUN_PIECES)
        for kind, text, trust, origin, author in zip(*[run.field(name).to_pylist() for name in ("kind", "text", "trust", "origin", "author")], strict=True):
            here = f"{_MARK}{math.floor(trust) + (trust % 1 >= 0.5)},{origin},{author}}}}}"
            if kind in _STARTS:
                yield text + here
            else:
                yield here + text if kind in ("word", "entity") and here != last else text
            last = "" if kind in _APART else last if kind == "space" else here


def marked_text(pieces: Column) -> Column:
    """The text of pieces again, with a mark before the first word and wherever trust, origin or author change, and behind line markup."""
    return by_slices(lambda rows: pa.array(["".join(_marked(row.values)) if row.is_valid else None for row in rows], pa.string()), "string", pieces)
