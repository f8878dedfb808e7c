"""Suffix-array dedup: remove byte strings that already start earlier in the collection.

The unit is a window of ``WIDTH`` bytes.  Spark first files every window
under its anchor, the ``GRAM``-byte string of least hash inside it, so equal
windows are filed together; neighbouring windows with one anchor occurrence form a *piece*
(the window starts and ``WIDTH - 1`` bytes more).  Only pieces whose anchor
occurs again are laid out and shuffled by anchor.

Inside a partition the pieces of some anchors form the document collection of a
column-wise construction: each round inserts one more symbol of every
piece, from its right end, into the Burrows-Wheeler transform of the
collection (all new positions follow from one stable counting sort of the
transform, read in sequence).  After the last column the suffixes stand in
sorted order; the common prefixes of neighbours give the classes of equal
windows, and every window but the earliest of its class is marked.  The
pieces come through Spark's sorted shuffle files in sequence, so a batch
(``BATCH_BYTES``) is all that a task holds.

Identical pieces enter the construction once.  The windows of an anchor
that more than ``HOT_ANCHOR`` documents hold are laid out one by one under
their own digest, so that no anchor gathers an unbounded collection in one
task.  Exact copies of a whole text are decided from its digest.

Null texts are empty.  Rows without a doc_id come back unchanged and match
nothing.  ``doc_id`` is the key; if rows repeat it, each is cut by the
ranges found for that id.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, SLICE_BYTES, cut, doc_texts, encoded, mix, slices, span_hashes
from .recompression import exact_copies

WIDTH = 100
GRAM = 24
BATCH_BYTES = 96 << 10
HOT_ANCHOR = 20_000
#: Bytes of text that are filed at a time; their arrays of numbers stay near the processor.
FILED_BYTES = 128 << 10
#: Symbols of the transform that are counted together.
BLOCK = 256

_KEYS = "key long, doc_id long, many boolean"
_PIECES = "key long, doc_id long, start long, size int, data binary"
_RANGES = "doc_id long, start long, stop long"


def _segments(texts: list[bytes], width: int) -> list[tuple[int, int, bytes]]:
    """(text, offset, bytes): long texts in overlapping segments that share no window."""
    out = []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), SLICE_BYTES):
            out.append((i, at, t[at : at + SLICE_BYTES + width - 1]))
    return out


def _sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    size = 1
    while size * 2 <= k:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (k - size)], a[k - size :]) if k > size else a


def filed_pieces(parts: list[bytes], width: int, gram: int):
    """(bytes, key, part, first window, number of windows) of every piece; windows by their place in the bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return data, np.zeros(0, np.uint64), none, none, none
    sizes = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(data) - gram + 1)
    grams = span_hashes(_BYTE[data], at, at + gram)
    # the place in the low bits makes equal hashes fall to the leftmost
    code = (grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    anchor = (_sliding_min(code, width - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = owner[: len(anchor)] == owner[width - 1 :]
    new = valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]))
    start = np.flatnonzero(new)
    if not len(start):
        return data, np.zeros(0, np.uint64), none, none, none
    size = np.bincount((np.cumsum(new) - 1)[valid], minlength=len(start))
    return data, mix(grams[anchor[start]]), owner[start], start, size


def _batches_of(texts: list[bytes], width: int, gram: int):
    parts = _segments(texts, width)
    for a, b in slices([p[2] for p in parts], FILED_BYTES):
        data, key, part, start, size = filed_pieces([p[2] for p in parts[a:b]], width, gram)
        if len(key):
            first = np.concatenate(([0], np.cumsum([len(p[2]) for p in parts[a:b]])[:-1]))
            text = np.array([p[0] for p in parts[a:b]])[part]
            offset = np.array([p[1] for p in parts[a:b]])[part] + start - first[part]
            yield data, key.view(np.int64), text, start, size, offset


def _anchors(batches: Iterator[pd.DataFrame], width: int, gram: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf[pdf["doc_id"].notna()]
        ids = pdf["doc_id"].to_numpy(np.int64)
        for _, key, text, *_ in _batches_of(encoded(pdf["text"]), width, gram):
            order = np.lexsort((key, text))
            key, text = key[order], text[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]))))
            many = np.diff(np.concatenate((new, [len(key)]))) > 1
            yield pd.DataFrame({"key": key[new], "doc_id": ids[text[new]], "many": many})


def _pieces(batches: Iterator[pd.DataFrame], width: int, gram: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys, hot = pdf["doc_id"].tolist(), list(pdf["keys"]), list(pdf["hot"])
        of, wanted, frequent, before = -1, frozenset(), frozenset(), set()
        for data, key, text, start, size, offset in _batches_of(encoded(pdf["text"]), width, gram):
            blob = data.tobytes()
            out = []
            for i, anchor, s, n, o in zip(text.tolist(), key.tolist(), start.tolist(), size.tolist(), offset.tolist(), strict=True):
                if i != of:
                    of, wanted, frequent, before = i, frozenset(np.asarray(keys[i], np.int64).tolist()), frozenset(np.asarray(hot[i], np.int64).tolist()), set()
                if anchor not in wanted:
                    continue
                if anchor in frequent:
                    at = np.arange(n)
                    names = span_hashes(_BYTE[data[s : s + n + width - 1]], at, at + width).view(np.int64).tolist()
                    made = [(names[k], o + k, blob[s + k : s + k + width]) for k in range(n)]
                else:
                    made = ((anchor, o, blob[s : s + n + width - 1]),)
                for name, place, piece in made:
                    # a piece that this text had before is decided here; its row goes anywhere
                    if piece in before:
                        out.append((name ^ (place * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF), ids[i], place, len(piece), None))
                    else:
                        before.add(piece)
                        out.append((name, ids[i], place, len(piece), piece))
            if out:
                *numbers, pieces = zip(*out, strict=True)
                made = {c: np.array(x, np.int64) for c, x in zip(["key", "doc_id", "start", "size"], numbers, strict=True)}
                yield pd.DataFrame({**made, "data": pd.Series(pieces, dtype=object)})


def column_wise_order(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, suffix length) of all suffixes of a collection, in sorted order.

    One round per column, from the right: the transform holds, for every
    suffix so far, the symbol before it (0 at the start of a piece, other
    symbols from 1).  The place of the suffix that a symbol and the suffix behind it
    make is the number of smaller symbols in the transform and of equal ones above;
    these are counted by blocks.  The whole transform gives all places again, for the suffixes of a column at a time.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    # longest first: the pieces that reach a column are the first ones
    longest = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    stops = np.cumsum(sizes)[longest]
    sizes = sizes[longest]
    columns = int(sizes.max(initial=0))
    reach = np.searchsorted(-sizes, -np.arange(columns + 2), side="right").tolist()
    used = np.bincount(flat, minlength=256) > 0
    count = int(used.sum()) + 1
    flat = np.cumsum(used).astype(np.uint8 if count < 256 else np.uint16)[flat]
    first = np.arange(len(flat) + m) // BLOCK * count
    # whole blocks; what lies behind the first n symbols is never counted
    n, bwt = m, np.zeros((m // BLOCK + 1) * BLOCK, flat.dtype)
    if columns:
        bwt[: reach[1]] = flat[stops[: reach[1]] - 1]
    place, inside = np.arange(m), np.arange(BLOCK, dtype=np.uint8)
    for column in range(1, columns + 1):
        k, more = reach[column], reach[column + 1]
        place = place[:k]
        symbol = bwt[place]
        blocks = len(bwt) // BLOCK
        above = np.zeros((blocks + 1, count), np.int64)
        np.cumsum(np.bincount(first[:n] + bwt[:n], minlength=blocks * count).reshape(blocks, count), axis=0, out=above[1:])
        smaller = np.concatenate(([0], m - above[-1, 0] + np.cumsum(above[-1, :-1])))
        block, rest = place // BLOCK, (place % BLOCK).astype(np.uint8)
        equal = (bwt.reshape(-1, BLOCK)[block] == symbol[:, None]) & (inside < rest[:, None])
        place = smaller[symbol] + above[block, symbol] + equal.sum(axis=1, dtype=np.uint16)
        grown = np.empty(((n + k) // BLOCK + 1) * BLOCK, bwt.dtype)
        old = np.ones(n + k, bool)
        old[place] = False
        grown[: n + k][old] = bwt[:n]
        grown[place[:more]] = flat[stops[:more] - column - 1]
        grown[place[more:]] = 0
        bwt, n = grown, n + k
    bwt = bwt[:n]
    behind = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[behind] = np.arange(n)  # as many symbols are 0 as suffixes are empty
    piece, length = np.empty(n, np.int64), np.zeros(n, np.int64)
    place = np.arange(m)
    piece[:m] = longest
    for column in range(1, columns + 1):
        place = to[place[: reach[column]]]
        piece[place], length[place] = longest[: reach[column]], column
    return piece, length


def repeated_windows(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece its windows that an earlier piece of the list has as well."""
    piece, length = column_wise_order(pieces)
    whole = length >= width
    piece, length = piece[whole], length[whole]
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.cumsum(sizes)[piece] - length
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    same = np.zeros(len(at), bool)
    for a in range(1, len(at), 1 << 15):
        b = min(len(at), a + (1 << 15))
        same[a:b] = (view[at[a:b]] == view[at[a - 1 : b - 1]]).all(axis=1)
    group = np.cumsum(~same)
    first = np.full(group[-1] + 1 if len(group) else 1, len(pieces))
    np.minimum.at(first, group, piece)
    later = piece > first[group]
    out: list[list[int]] = [[] for _ in pieces]
    for p, w in zip(piece[later], (sizes[piece] - length)[later], strict=True):
        out[p].append(int(w))
    return [np.sort(np.array(x, np.int64)) for x in out]


def _resolve(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Ranges of bytes that occur earlier; rows come sorted by (key, doc_id, start)."""
    groups: list[dict[bytes, tuple[int, int]]] = []
    held, key, last = 0, None, {}

    def built():
        flat = [(d, o) for g in groups for d, o in g.items()]
        for (data, (doc, start)), windows in zip(flat, repeated_windows([d for d, _ in flat], width), strict=True):
            if len(windows):
                new = np.concatenate(([True], np.diff(windows) > 1))
                lo, hi = windows[new], windows[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(windows) - 1]))]
                yield from ((doc, start + int(x), start + int(y) + width) for x, y in zip(lo, hi, strict=True))

    for pdf in batches:
        out = []
        for k, doc, start, size, data in zip(pdf["key"], pdf["doc_id"], pdf["start"], pdf["size"], pdf["data"], strict=True):
            if data is None:
                out.append((doc, start, start + size))
                continue
            if k != key:
                if len(last) > 1:
                    groups.append(last)
                    held += sum(map(len, last))
                    if held > BATCH_BYTES:
                        out += built()
                        groups, held = [], 0
                key, last = k, {}
            if data in last:
                if last[data] != (doc, start):
                    out.append((doc, start, start + len(data)))
            else:
                last[data] = (doc, start)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop"])
    if len(last) > 1:
        groups.append(last)
    if groups and (out := list(built())):
        yield pd.DataFrame(out, columns=["doc_id", "start", "stop"])


def _cut(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, ranges, copy in zip(encoded(pdf["text"]), pdf["ranges"], pdf["copy"], strict=True):
            n, removed, spans, kept = len(text), 0, 0, text
            if copy and n >= width:
                removed, spans, kept = n, 1, b""
            elif ranges is not None and len(ranges):
                merged: list[list[int]] = []
                for lo, hi in sorted((r["start"], r["stop"]) for r in ranges):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    elif hi <= n:
                        merged.append([lo, hi])
                removed, spans = sum(hi - lo for lo, hi in merged), len(merged)
                edges = [0, *(x for m in merged for x in m), n]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((n, removed, spans, hashlib.sha256(kept).hexdigest()))
        made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), made], axis=1)


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts earlier (smaller doc_id, or earlier in the text).

    Returns one row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256.
    """
    docs = doc_texts(docs)
    known = docs.where("doc_id is not null")
    anchors = docs.mapInPandas(lambda it: _anchors(it, width, gram), _KEYS)
    by_key = Window.partitionBy("key").orderBy("doc_id")
    shared = (
        anchors.select("key", "doc_id", "many", F.lag("key").over(by_key).alias("before"), F.lead("key").over(by_key).alias("after"), F.row_number().over(by_key).alias("n"))
        .where("many or before is not null or after is not null")
        .select("doc_id", "key", "n")
    )
    copies = cut(exact_copies(docs))
    shared = cut(shared.join(copies, "doc_id", "left_anti"))
    hot = shared.where(F.col("n") > hot_anchor).select("key").distinct().withColumn("is_hot", F.lit(True))
    wanted = shared.join(hot, "key", "left").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
    pieces = known.join(wanted, "doc_id").select("doc_id", "text", "keys", "hot").mapInPandas(lambda it: _pieces(it, width, gram), _PIECES)
    ordered = pieces.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    # written, so that the pieces are off the disks when the texts move again
    ranges = cut(ordered.mapInPandas(lambda it: _resolve(it, width), _RANGES).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))
    marked = known.join(ranges, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    marked = marked.unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    return marked.select("doc_id", "text", "ranges", F.coalesce("copy", F.lit(False)).alias("copy")).mapInPandas(lambda it: _cut(it, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
