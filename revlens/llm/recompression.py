"""Substring dedup by recompression.

Every text is a sequence of words.  Recompression rewrites all texts by
the same rule at once: a round first names runs of one symbol, then splits
the symbols into left and right ones by a bit of their name and names every
pair of a left and a following right symbol.  A name is a 64-bit digest of
what it stands for, so each Spark task gives equal strings equal names
without a dictionary to distribute.

Beside its extent each symbol carries its *context*: the words that decide
how it was parsed.  If the context lies inside a window of ``width`` words,
every equal window holds the same symbol at the same place.  A window is
filed under the symbol of least name among these (a window without one, as
inside a long run, under its own words), so equal windows are always filed
together.  Spark then

1. shuffles the high-level symbols by name and keeps those that more than
   one document has;
2. names the windows filed under shared symbols by a digest of their words,
   made from other names of the words than the symbol's, so that the two have
   128 independent bits: the check of a candidate;
3. finds the smallest document of each window name, and marks every window
   that an earlier document has too.

Both groupings hold at most one row per document and name in sorted
streams, so a passage that a third of all documents share costs one row of
each, not a pair.  Exact copies of a whole text are decided from its digest;
only the first copy enters step 2.

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

from .common import cut, doc_texts, encoded, mix, range_names, run_names, set_aside, slices, small_batches, word_hashes

WIDTH = 13
ROUNDS = 2
#: Parts of a group of equal texts.
SALTS = 16
_RUN, _PAIR, _SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _rounds(words: np.ndarray, counts: np.ndarray, rounds: int):
    """Yield (name, start, end, context start, context end) after each round, in word positions.

    A context that reaches the edge of a text ends beyond it, so that no
    window contains it.
    """
    n = len(words)
    text_of = np.repeat(np.arange(len(counts)), counts)
    name, s, e, text = words, np.arange(n), np.arange(1, n + 1), text_of
    lo, hi = s.copy(), e.copy()
    for level in range(rounds):
        if len(name) < 2:
            return
        # runs of one symbol
        joined = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~joined)))
        last = np.concatenate((head[1:], [len(name)])) - 1
        length = last - head + 1
        before, after = np.maximum(head - 1, 0), np.minimum(last + 1, len(name) - 1)
        far = 1 << 40
        new_lo = np.where((head > 0) & (text[before] == text[head]), lo[before], -far)
        new_hi = np.where((last < len(name) - 1) & (text[after] == text[last]), hi[after], far)
        name = np.where(length > 1, mix(name[head] ^ (length.astype(np.uint64) * _RUN)), name[head])
        s, e, text = s[head], e[last], text[head]
        lo, hi = np.minimum(new_lo, lo[head]), np.maximum(new_hi, hi[last])
        # pairs of a left and a right symbol
        right = (mix(name + mix(np.array([level + 1], np.uint64) * _SIDE)) & np.uint64(1)).astype(bool)
        same = np.concatenate((text[1:] == text[:-1], [False]))
        pair = same & ~right & np.concatenate((right[1:], [False]))
        second = np.concatenate(([False], pair[:-1]))
        nxt, prev = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        prev_same = np.concatenate(([False], same[:-1]))
        # what decided it: the partner, or the neighbour that was none
        hi2 = np.where(right, hi, np.where(same, np.maximum(hi, hi[nxt]), far))
        lo2 = np.where(right, np.where(prev_same, np.minimum(lo, lo[prev]), -far), lo)
        name2 = np.where(pair, mix(mix(name ^ _PAIR) + name[nxt] * np.uint64(3)), name)
        e2 = np.where(pair, e[nxt], e)
        lo2 = np.where(pair, np.minimum(lo, lo[nxt]), lo2)
        keep = ~second
        name, s, e, lo, hi, text = name2[keep], s[keep], e2[keep], lo2[keep], hi2[keep], text[keep]
        yield name, s, e, lo, hi


def filed_windows(words: np.ndarray, counts: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS):
    """File every window under a symbol: (key, first window, number of windows), windows by their first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    valid = text_of[:n] == text_of[width - 1 :]
    best = np.zeros(n, np.uint64)
    keys: list[np.ndarray] = [np.zeros(1, np.uint64)]
    made = 1
    for name, s, e, lo, hi in _rounds(words, counts, rounds):
        fits = np.flatnonzero((lo >= 0) & (hi - lo <= width) & (e - s > 1))
        if not len(fits):
            continue
        lo, hi = lo[fits], hi[fits]
        context = range_names(words, lo, hi)
        key = mix(name[fits] ^ context)
        # ordered by name, so by content alone: the same choice in every equal window
        code = (key >> np.uint64(32) << np.uint64(32)) | np.arange(made, made + len(fits), dtype=np.uint64)
        keys.append(key)
        made += len(fits)
        first = np.maximum(hi - width, 0)
        for t in range(width):
            at = first + t
            ok = (at <= lo) & (at < n)
            np.maximum.at(best, at[ok], code[ok])
    all_keys = np.concatenate(keys)
    number = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(valid & np.concatenate(([True], (number[1:] != number[:-1]) | ~valid[:-1])) | (valid & (number == 0)))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run_of = np.zeros(n + 1, np.int64)
    run_of[start] = 1
    run_of = np.cumsum(run_of[:n]) - 1
    size = np.bincount(run_of[valid], minlength=len(start))
    key = all_keys[number[start]]
    alone = number[start] == 0
    if alone.any():
        key[alone] = run_names(words, width)[start[alone]]
    return key, start, size


# --- Spark ----------------------------------------------------------------

_ANCHORS = "key long, doc_id long"
_WINDOWS = "key long, digest long, doc_id long, start int, more binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _symbols(batches: Iterator[pd.DataFrame], width: int, rounds: int) -> Iterator[pd.DataFrame]:
    """The distinct symbols under which the windows of each document are filed."""
    for pdf in batches:
        pdf = pdf[pdf["doc_id"].notna()]
        texts, ids = encoded(pdf["text"]), pdf["doc_id"].to_numpy(np.int64)
        for a, b in slices(texts):
            words, counts = word_hashes(texts[a:b])
            key, start, _ = filed_windows(words, counts, width, rounds)
            if len(key):
                owner = np.repeat(ids[a:b], counts)[start]
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
                yield pd.DataFrame({"key": _signed(key[new]), "doc_id": owner[new]})


def _windows(batches: Iterator[pd.DataFrame], width: int, rounds: int) -> Iterator[pd.DataFrame]:
    """The windows filed under a document's shared symbols, named by their words."""
    for pdf in batches:
        texts, ids, shared = encoded(pdf["text"]), pdf["doc_id"].to_numpy(np.int64), list(pdf["keys"])
        for a, b in slices(texts):
            words, counts = word_hashes(texts[a:b])
            key, start, size = filed_windows(words, counts, width, rounds)
            if not len(key):
                continue
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))
            text_of = np.repeat(np.arange(a, b), counts)[start]
            edges = np.searchsorted(text_of, np.arange(a, b + 1))
            wanted = np.zeros(len(key), bool)
            for i in range(a, b):
                lo, hi = edges[i - a], edges[i - a + 1]
                if hi > lo:
                    wanted[lo:hi] = np.isin(_signed(key[lo:hi]), np.asarray(shared[i], np.int64))
            if not wanted.any():
                continue
            key, start, size, text_of = key[wanted], start[wanted], size[wanted], text_of[wanted]
            total = int(size.sum())
            at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            digest = run_names(word_hashes(texts[a:b], salt=1)[0], width)[at]
            text_at = np.repeat(text_of, size)
            key, at = np.repeat(key, size), (at - first[text_at - a]).astype(np.int32)
            # one row for all places of a window in its document
            order = np.lexsort((at, digest, text_at))
            key, digest, text_at, at = key[order], digest[order], text_at[order], at[order]
            new = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (key[1:] != key[:-1]) | (text_at[1:] != text_at[:-1]))))
            stop = np.concatenate((new[1:], [len(at)]))
            more = np.full(len(new), None, object)
            for i in np.flatnonzero(stop - new > 1):
                more[i] = at[new[i] + 1 : stop[i]].tobytes()
            yield pd.DataFrame({"key": _signed(key[new]), "digest": _signed(digest[new]), "doc_id": ids[text_at[new]], "start": at[new], "more": more})


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of every text that a document with a smaller id has as well.

    Only digests that occur twice go on; their rows meet the first id in ``SALTS`` parts, so that no group of copies is one task's.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    seen = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("name"), F.sha2("text", 256).alias("sha"), salt.alias("salt"))
    first = seen.groupBy("name", "sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    first = first.select("name", "sha", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return seen.join(first, ["name", "sha", "salt"]).where("doc_id > first_id").select("doc_id").distinct()


def _cut(batches: Iterator[pd.DataFrame], width: int, keep_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, starts, more, copy in zip(encoded(pdf["text"]), pdf["starts"], pdf["more"], pdf["copy"], strict=True):
            words = text.split()
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            if copy and n >= width:
                gone[0], gone[n] = 1, -1
            elif starts is not None and len(starts):
                at = np.unique(np.concatenate((np.asarray(starts, np.int64), *(np.frombuffer(m, np.int32) for m in more))))
                at = at[at + width <= n]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
            removed = np.cumsum(gone[:n]) > 0
            if keep_text and not removed.any():
                out.append(text.decode("utf-8", "surrogatepass"))
                continue
            left = [w for w, r in zip(words, removed, strict=True) if not r] if removed.any() else words
            kept = b" ".join(left)
            out.append(kept.decode("utf-8", "surrogatepass") if keep_text else (n, int(removed.sum()), hashlib.sha256(kept).hexdigest()))
        if keep_text:
            yield pdf.drop(columns=["starts", "more", "copy"]).assign(text=out)
        else:
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), made], axis=1)


def _marked(rows: DataFrame, width: int, rounds: int) -> DataFrame:
    """``rows`` (doc_id, text and others) with the first words of the windows to remove: starts, more, copy."""
    docs = rows.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    symbols = docs.mapInPandas(lambda it: _symbols(it, width, rounds), _ANCHORS)
    by_key = Window.partitionBy("key").orderBy("doc_id")
    shared = cut(
        symbols.select("*", F.lag("doc_id").over(by_key).alias("before"), F.lead("doc_id").over(by_key).alias("after"))
        .where((F.col("before") != F.col("doc_id")) | (F.col("after") != F.col("doc_id")))
        .select("doc_id", "key")
    )
    copies = cut(exact_copies(docs))
    wanted = shared.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    windows = known.join(wanted, "doc_id").select("doc_id", "text", "keys").mapInPandas(lambda it: _windows(it, width, rounds), _WINDOWS)
    by_name = Window.partitionBy("key", "digest").orderBy("doc_id")
    repeats = windows.select("doc_id", "start", "more", F.first("doc_id").over(by_name).alias("first_id")).where("first_id < doc_id")
    # written, so that the windows are off the disks when the texts move again
    starts = cut(repeats.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("more").alias("more")))
    marked = rows.where("doc_id is not null").join(starts, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    marked = marked.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return marked.withColumn("copy", F.coalesce("copy", F.lit(False)))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Remove every word covered by ``width`` words that also start in a document with a smaller id.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed and
    kept_sha256 (of the kept words joined by one space).
    """
    marked = _marked(doc_texts(docs), width, rounds).select("doc_id", "text", "starts", "more", "copy")
    return marked.mapInPandas(lambda it: _cut(it, width, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the repeated words removed from ``text`` (kept words joined by one space; texts without any are unchanged)."""
    small_batches(docs.sparkSession)
    safe, restored = set_aside(docs, "doc_id", "text")
    rows = safe.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    return restored(_marked(rows, width, rounds).select(*rows.columns, "starts", "more", "copy").mapInPandas(lambda it: _cut(it, width, True), rows.schema))
