"""Page-history dumps in XML: reading, overlaying updates, splitting and writing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

#: Splits whose open pages are sent to every executor at most; with more of them pieces are shuffled to theirs.
BROADCAST_SPLITS = 100_000
_REVISION_END = "</revision>"
_ROWS = "file string, page_id long, title string, rev_id long, timestamp string, user_id long, ip string, username string, is_minor boolean, comment string, text string, error string"
_TITLE, _NUMBER = re.compile(r"<title>(.*?)</title>", re.DOTALL), re.compile(r"<id>\s*(\d+)\s*</id>")


def _header(piece: str) -> tuple[int | None, str] | None:
    """(id, title) of the last page that begins in a piece of a dump."""
    at = piece.rfind("<page>")
    if at < 0:
        return None
    head = piece[at:].partition("<revision>")[0]
    title, number = _TITLE.search(head), _NUMBER.search(head)
    return (int(number[1]) if number else None, unescape(title[1], {"&quot;": '"', "&apos;": "'"}) if title else "")


def _revision(piece: str) -> dict:
    """The fields of the revision that a piece ends with; ``error`` says what is wrong with it."""
    empty = dict.fromkeys(("rev_id", "timestamp", "user_id", "ip", "username", "is_minor", "comment", "text"))
    at = piece.rfind("<revision>")
    if at < 0:
        return {**empty, "error": "a revision ends that did not begin"}
    try:
        root = ElementTree.fromstring(piece[at:] + _REVISION_END)
    except ElementTree.ParseError as error:
        return {**empty, "error": str(error)}
    value = lambda path: root.findtext(path)
    number, user = value("id"), value("contributor/id")
    if number is None or not number.strip().isdigit():
        return {**empty, "error": "a revision without a number"}
    name = value("contributor/username")
    return {
        "rev_id": int(number), "timestamp": value("timestamp"), "user_id": int(user) if user and user.strip().isdigit() else 0, "ip": value("contributor/ip"), "username": name if name is not None else value("contributor/ip"),
        "is_minor": root.find("minor") is not None, "comment": value("comment"), "text": value("text") or "", "error": None,
    }


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Revisions of each split in its order; a piece without a page's beginning belongs to the page before it."""
    split, header = None, None
    names = [c.split()[0] for c in _ROWS.split(", ")]
    for pdf in batches:
        out = []
        for file, start, piece, start_id, start_title in zip(pdf["file"], pdf["start"], pdf["value"], pdf["start_id"], pdf["start_title"], strict=True):
            if (file, start) != split:
                split, header = (file, start), None if start_title is None else (None if pd.isna(start_id) else int(start_id), start_title)
            header = _header(piece) or header
            ends = "<revision>" not in piece and ("</page>" in piece or not piece.strip() or "</mediawiki>" in piece)
            if ends:  # what stands behind the last revision of a dump
                continue
            told = _revision(piece)
            if told["error"] is None and (header is None or header[0] is None):
                told["error"] = "a revision of no page"
            out.append({"file": file, "page_id": header[0] if header else None, "title": header[1] if header else None, **told})
            if len(out) >= 500:
                yield _typed(out, names)
                out = []
        if out:
            yield _typed(out, names)


def _typed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("page_id", "rev_id", "user_id")}).astype({"is_minor": "boolean"})


def read_pieces(spark: SparkSession, path: str, ignore_corrupt: bool = False, by_file: bool = False) -> DataFrame:
    """Every revision of a dump (a file, a folder or a glob; compressed by extension), sound or not: fields, and ``error`` for what is broken.

    A file is read as a stream of revisions, in splits where its codec allows
    it; no page is ever one row.  A first scan notes the last page that begins in each split, which is where
    the revisions at the start of the next one belong.  Files that can't be unpacked end where they break if ``ignore_corrupt``.
    With ``by_file`` a file holds revisions of the page that its name numbers.
    """
    raw = spark.read.option("lineSep", _REVISION_END).option("recursiveFileLookup", str(by_file).lower()).option("ignoreCorruptFiles", str(ignore_corrupt).lower()).text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    begins = pieces.where(F.col("value").contains("<page>")).withColumn("at", F.monotonically_increasing_id())
    head = F.substring_index(F.substring_index("value", "<page>", -1), "<revision>", 1)
    last = begins.groupBy("file", "start").agg(F.max_by(head, "at").alias("head"))
    splits = pieces.select("file", "start").distinct().join(last, ["file", "start"], "left")
    before = F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    opened = written(splits.select("file", "start", before.alias("head")))  # a row for each split
    title = F.regexp_extract("head", "(?s)<title>(.*?)</title>", 1)
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(title, F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    number = F.expr("try_cast(regexp_extract(head, '<id>([0-9]+)</id>', 1) as bigint)")
    if by_file:
        opened = opened.withColumn("head", F.lit(""))
        number = F.expr(r"try_cast(regexp_extract(file, '([0-9]+)[.]xml[^/]*$', 1) as bigint)")
    starts = opened.select("file", "start", F.when(F.col("head").isNotNull(), plain).alias("start_title"), number.alias("start_id"))
    if opened.count() <= BROADCAST_SPLITS:  # a row for each split; the pieces stay where they are, in their order
        return pieces.join(F.broadcast(starts), ["file", "start"], "left").mapInPandas(_parsed, _ROWS)
    placed = pieces.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "start"], "left")
    return placed.repartition("file", "start").sortWithinPartitions("file", "start", "at").mapInPandas(_parsed, _ROWS)


def broken(pieces: DataFrame) -> DataFrame:
    """(file, page_id, title, error) of the pieces that are no revisions."""
    return pieces.where("error is not null").select("file", "page_id", "title", "error")


def read_dump(spark: SparkSession, path: str, main_only: bool = True, leading_newline: bool = False, ignore_corrupt: bool = False) -> DataFrame:
    """One row per sound revision of the pages of a dump; ``broken`` of ``read_pieces`` tells of the others.

    Pages whose title has a colon belong to other namespaces and are left out
    with ``main_only``.  Anonymous authors have the user id 0.  With ``leading_newline`` texts begin a line, as tokenizers take them.
    """
    revs = read_pieces(spark, path, ignore_corrupt).where("error is null")
    if main_only:
        revs = revs.where(~F.col("title").contains(":"))
    return _fields_of(revs, F.concat(F.lit("\n"), F.col("text")) if leading_newline else F.col("text"))


def _fields_of(revs: DataFrame, text: Column) -> DataFrame:
    ts = F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return revs.select("page_id", "title", "rev_id", ts.alias("ts"), F.unix_timestamp(ts).cast("double").alias("time"), "user_id", "ip", "username", "is_minor", "comment", text.alias("text"))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Revisions in a tree of files such as ``000/000/123/000000123456.xml.gz``: each holds later revisions of the page of its number.

    The columns are those of ``read_dump`` but for the title.
    """
    return _fields_of(read_pieces(spark, path, by_file=True).where("error is null"), F.col("text")).drop("title")


def with_updates(dump: DataFrame, updates: DataFrame, page: str = "page_id", time: str = "time") -> DataFrame:
    """The dump, and of the updates to its pages those later than the page's last revision in it; what they lack is the page's."""
    more = [c for c in dump.columns if c not in updates.columns]
    ends = dump.groupBy(page).agg(F.max(time).alias("_end"), *[F.max_by(c, time).alias(c) for c in more])
    later = updates.join(ends, page).where(F.col(time) > F.col("_end")).drop("_end")
    return dump.unionByName(later.select(dump.columns))


def chunked(pages: DataFrame, page: str, per_chunk: int) -> DataFrame:
    """``chunk``: pages in id order, ``per_chunk`` to each.

    Ranges of ids are sorted in parallel; only the number of pages in each
    range is summed up, so no task sees all pages.
    """
    ids = pages.select(page).distinct().repartitionByRange(page).sortWithinPartitions(page)
    # written, since a partition's number holds for one run only
    placed = written(ids.withColumn("_part", F.spark_partition_id()))
    placed = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(page)) - 1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_part")  # a row for each shuffle partition
    return pages.join(numbered.select(page, F.floor((F.col("_before") + F.col("_in")) / per_chunk).cast("long").alias("chunk")), page)


_NO_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _escaped(text: str) -> str:
    return escape(_NO_XML.sub("\ufffd", text), {"\r": "&#13;"})


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one dump; rows come sorted by page."""
    page, begun = None, False
    for pdf in batches:
        lines = [] if begun or pdf.empty else ["<mediawiki>"]
        begun |= bool(lines)
        for r in pdf.itertuples(index=False):
            if (r.page_id, r.title) != page:
                lines += ["</page>"] * (page is not None) + [f"<page>\n<title>{_escaped(r.title)}</title>\n<id>{r.page_id}</id>"]
                page = (r.page_id, r.title)
            author = f"<username>{_escaped(r.username or '')}</username><id>{r.user_id}</id>" if r.user_id else f"<ip>{_escaped(r.ip or r.username or '')}</ip>"
            more = "<minor />" * bool(r.is_minor) + (f"<comment>{_escaped(r.comment)}</comment>" if r.comment is not None else "")
            lines.append(f'<revision><id>{r.rev_id}</id><timestamp>{r.stamp}</timestamp><contributor>{author}</contributor>{more}<text xml:space="preserve">{_escaped(r.text or "")}</text></revision>')
        if lines:
            yield pd.DataFrame({"value": lines})
    if begun:
        yield pd.DataFrame({"value": ["</page>\n</mediawiki>"]})


def write_dump(revs: DataFrame, path: str, compression: str | None = None, files: int | None = None) -> None:
    """Revisions as dumps that ``read_dump`` reads: ranges of pages to a file, a page's revisions in time order, one after the other.

    Each file is a dump of its own; a page is in one file and is never gathered.
    """
    by = ["page_id", "title"]
    dealt = revs.repartitionByRange(files, *by) if files else revs.repartitionByRange(*by)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")
    ordered = dealt.sortWithinPartitions(*by, "ts", "rev_id").select(*by, "rev_id", stamp, F.coalesce("user_id", F.lit(0)).alias("user_id"), "username", "ip", "is_minor", "comment", "text")
    ordered.mapInPandas(_rendered, "value string").write.text(path, compression=compression)
