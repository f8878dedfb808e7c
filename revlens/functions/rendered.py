"""Marks of trust in rendered pages: from marks in the text to spans that a style colours."""

from __future__ import annotations

import re
from html import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_slices

# A mark, the classes of colour, and the stretch of text that a mark holds for.
_MARK = r"\{\{#t:(\d+),(\d+),([^}]+)\}\}"
CLASSES, SCALE = 10, 10
_MARKED = re.compile(_MARK + r"([^{<][^<]*?)(?=\{\{#t:|<|\Z)")
_ANY_MARK = re.compile(r"\{\{#t:\d+,\d+,[^}]+\}\}")
_SECTION_TITLE = re.compile(r'(<span class="editsection"[^>]*>.*? title=")(.*?)(">)')
_PARTED_TERM = re.compile(r"<dt>\{\{#t</dt>\n<dd>(.*?)</dd>")


def trust_class(trust: float, median: float) -> int:
    """The colour of a trust: ten classes over the median of all trust."""
    return int(min(CLASSES - 1, max(0.0, (trust + 0.5) * SCALE / (median or 1.0))))


def with_spans(html: str, median: float, authors: bool = True) -> str:
    """A rendered page with a span around what each mark holds for, which tells its origin and, with ``authors``, who wrote it.

    A term that a mark's colon parted is joined again, titles of section links lose their marks, and so does all that no text follows.
    """
    html = _PARTED_TERM.sub(r"<dt>{{#t:\1</dt>", html)
    html = _SECTION_TITLE.sub(lambda m: m[1] + _ANY_MARK.sub("", m[2]) + m[3], html)

    def span(m: re.Match) -> str:
        by = f' title="{escape(m[3])}"' if authors else ""
        return f'<span class="trust{trust_class(float(m[1]), median)}" data-origin="{m[2]}"{by}>{m[4]}</span>'

    return _ANY_MARK.sub("", _MARKED.sub(span, html))


def coloured_page(html: Column | str, median: Column | float, authors: bool = True) -> Column:
    """``with_spans`` over a column."""

    def spanned(pages: pa.Array, medians: pa.Array) -> pa.Array:
        return pa.array([None if p is None else with_spans(p, m, authors) for p, m in zip(pages.to_pylist(), medians.to_pylist(), strict=True)], pa.string())

    return by_slices(spanned, "string", html, median if isinstance(median, Column) else F.lit(float(median)))
