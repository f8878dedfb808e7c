"""Quality rules: counting rules, and the divergence of a document from its language.

Two histograms describe a document: bytes by character class, and words by
which common word they are.  The reference of a language pools the
histograms of all documents that are filed under it, each document with
weight one, so that long ones do not decide.  A document fails if its
Jensen-Shannon distance (square root of the divergence in bits) from every
language that it may be in exceeds the limits: those of ``COMMON``, and its own
if ``MIN_REFERENCE`` documents or more are filed under that.  Distances of short texts are mostly noise, so
each test has a least length below which it does not speak.

Null and empty texts have no words and fail the base rule.  A document whose
language has no reference is judged by the base rule alone; one without a
language is held against all references and adds to none.  Without any
reference only the base rule speaks.  Rows that repeat are judged each for
itself; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, byte_names, encoded, set_aside, slices, small_batches, split_words, window_hashes

MIN_WORDS = 50
#: Base rule: at most this share (in hundredths) of words in repeated three-word windows.
MAX_REPEATED = 50
#: Least bytes and words for the two distances to speak, and the distances that fail.
MIN_BYTES, MAX_CLASS_DISTANCE = 300, 0.30
MIN_COMMON_WORDS, MAX_WORD_DISTANCE = 120, 0.30
#: Documents (of ``MIN_WORDS`` or more) that a language not in ``COMMON`` needs for a reference.
MIN_REFERENCE = 20
#: Languages that a task sums up before it passes the sums on.
POOLED = 1000

# Frequent words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "en": "the of and to in a is that for it as was with be by on not he this are at from or have",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au il ne pas plus ce se",
}
LANGUAGES = tuple(COMMON)

_CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "letter beyond ASCII")
_CLASS = np.full(256, 6, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:!?'\"-", b"#*$%&|<>")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7
_SYMBOL = _CLASS == 5
_TRAIL = np.zeros(256, bool)
_TRAIL[list(b".,;:!?")] = True

_WORDS = sorted({w for line in COMMON.values() for w in line.split()})
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


#: Words are compared as numbers of eight bytes; no common word is longer.
_PACK = 8


def _packed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bytes of each span of up to eight as one number; 0 for a longer one."""
    size = stop - start
    out = np.zeros(len(start), np.uint64)
    for k in range(_PACK):
        at = np.minimum(start + k, len(data) - 1)
        out |= np.where(k < size, data[at], 0).astype(np.uint64) << np.uint64(8 * k)
    return np.where(size <= _PACK, out, 0)


def _common_codes() -> tuple[np.ndarray, np.ndarray]:
    data, start, end, _ = split_words([" ".join(_WORDS).encode()])
    names = _packed(data, start, end)
    order = np.argsort(names)
    return names[order], order


_NAMES, _CODES = _common_codes()


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return n


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(the counts of each text, its character classes, its common words with all others last)."""
    data, start, end, counts = split_words(texts)
    m = len(texts)
    owner = np.repeat(np.arange(m), counts)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    words = byte_names(data, start, end)
    names, at = window_hashes(words, counts, 3)
    order = np.lexsort((names, owner[at]))
    same = (names[order][1:] == names[order][:-1]) & (owner[at[order]][1:] == owner[at[order]][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.zeros(len(words) + 3, bool)
    for k in range(3):
        repeated[at[order[twice]] + k] = True
    classes, common = histograms(texts, data, start, end, counts)
    counted = {
        "n_words": counts,
        "word_chars": np.bincount(owner, chars[end] - chars[start], m).astype(np.int64),
        "n_symbols": classes[:, _CLASSES.index("symbol")],
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": np.bincount(owner, repeated[: len(words)], m).astype(np.int64),
    }
    return counted, classes, common


def histograms(texts: list[bytes], data, start, end, counts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each text by character class, its words by common word with all others last)."""
    m, k = len(texts), len(_CLASSES)
    sizes = np.array([len(t) for t in texts])
    byte_owner = np.repeat(np.arange(m, dtype=np.int32) * k, sizes + 1)
    classes = np.bincount(byte_owner + _CLASS[data], minlength=m * k).reshape(m, k)
    classes[:, _CLASSES.index("space")] -= 1  # the one that joins the texts
    stop = end.copy()
    for _ in range(2):
        stop -= (stop - start > 1) & _TRAIL[data[np.maximum(stop - 1, 0)]]
    short = np.flatnonzero(stop - start <= _PACK)
    packed = _packed(_LOWER[data], start[short], stop[short])
    place = np.minimum(np.searchsorted(_NAMES, packed), len(_NAMES) - 1)
    code = np.full(len(start), len(_WORDS))
    code[short] = np.where(_NAMES[place] == packed, _CODES[place], len(_WORDS))
    width = len(_WORDS) + 1
    return classes, np.bincount(np.repeat(np.arange(m), counts) * width + code, minlength=m * width).reshape(m, width)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from the distribution ``q``; 0 to 1."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def _sums(total: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, sums in total.items():
        yield pd.DataFrame({"lang": lang, "bin": np.arange(len(sums)), "share": sums})


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        texts = encoded(pdf["text"])
        for a, b in slices(texts):
            data, start, end, counts = split_words(texts[a:b])
            classes, common = histograms(texts[a:b], data, start, end, counts)
            langs = pdf["lang"].to_numpy()[a:b]
            long = counts >= MIN_WORDS
            for lang in pd.unique(langs[long & pd.notna(langs)]):
                own = long & (langs == lang)
                sums = np.concatenate((_shares(classes[own]).sum(axis=0), _shares(common[own]).sum(axis=0), [own.sum()]))
                total[lang] = total.get(lang, 0) + sums
            if len(total) > POOLED:
                yield from _sums(total)
                total = {}
    yield from _sums(total)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(character classes, common words) of each language that has enough documents: a few hundred numbers."""
    last = len(_CLASSES) + len(_WORDS) + 1
    pooled = docs.select("text", "lang").mapInPandas(_pooled, "lang string, bin int, share double").groupBy("lang", "bin").agg(F.sum("share").alias("share"))
    n = F.max(F.when(F.col("bin") == last, F.col("share"))).over(Window.partitionBy("lang"))
    found: dict[str, dict[int, float]] = {}
    for lang, at, share, _ in pooled.withColumn("n", n).where(F.col("lang").isin(*LANGUAGES) | (F.col("n") >= MIN_REFERENCE)).collect():  # one row per language and bin
        found.setdefault(lang, {})[at] = share
    out = {}
    for lang, shares in found.items():
        mean = np.array([shares[i] for i in range(len(shares))])
        out[lang] = (mean[: len(_CLASSES)] / mean[-1], mean[len(_CLASSES) : -1] / mean[-1])
    return out


def _judged(batches: Iterator[pd.DataFrame], known: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = encoded(pdf["text"])
        for a, b in slices(texts):
            counted, classes, common = measure(texts[a:b])
            n = counted["n_words"]
            base = (n < MIN_WORDS) | (100 * counted["n_repeat_words"] > MAX_REPEATED * n)
            far = np.zeros(len(n), bool)
            nearest_class, nearest_word = np.full(len(n), np.nan), np.full(len(n), np.nan)
            if known:
                langs = pdf["lang"].to_numpy()[a:b]
                unnamed = pd.isna(langs)
                by_class, by_word = np.full((2, len(known), len(n)), np.inf)
                for k, (lang, (c, w)) in enumerate(known.items()):
                    near = np.flatnonzero((lang in COMMON) | unnamed | (langs == lang))
                    by_class[k, near] = distance(_shares(classes[near]), c)
                    by_word[k, near] = distance(_shares(common[near]), w)
                bad = (by_class > MAX_CLASS_DISTANCE) & (classes.sum(axis=1) >= MIN_BYTES)
                bad |= (by_word > MAX_WORD_DISTANCE) & (n >= MIN_COMMON_WORDS)
                named = unnamed | np.isin(langs.astype(str), list(known))
                bad |= np.isinf(by_class)  # another language's own reference
                far = bad.all(axis=0) & named
                nearest_class, nearest_word = (np.where(np.isinf(x), np.nan, x) for x in (by_class.min(axis=0), by_word.min(axis=0)))
            made = pd.DataFrame({**counted, "base_failed": base, "kept": ~base & ~far, "class_distance": nearest_class, "word_distance": nearest_word})
            yield pd.concat([pdf.iloc[a:b].reset_index(drop=True), made], axis=1)


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and the least distances from a language.

    ``docs`` has doc_id, text and lang; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = references(docs)
    schema = f"doc_id long, text string, {_MEASURES}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return docs.mapInPandas(lambda it: _without_text(_judged(it, known)), schema.replace(" text string,", ""))


def _without_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns=["text", "lang"])


def _kept(batches: Iterator[pd.DataFrame], known) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kept = [made["kept"] for made in _judged(iter([pdf[["text", "lang"]]]), known)]
        if kept:
            yield pdf[pd.concat(kept).to_numpy()]


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    known = references(docs)
    safe, restored = set_aside(docs, "text", "lang")
    return restored(safe.mapInPandas(lambda it: _kept(it, known), safe.schema))
