"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders,
``P(w | h) = sum_k weight_k * c(h_k w) / c(h_k)`` with order 0 uniform over
the training vocabulary and one unknown word.  The weights depend on the
longest context that the training texts have and on how often they have it
(a bucket for each power of two).  They are learned by expectation-
maximisation on held-out counts: each training document is deleted in turn,
so its tokens are predicted from the counts of all others.

Counts go through exchanges of n-gram names.  Documents are packed into
shards; a shard sends each distinct n-gram once, with its training count, to
the bucket of its name, a bucket adds up, and sends the totals back in the
order asked for.  So a frequent n-gram costs one entry per shard, and the
buckets' number follows the corpus.  Words and pairs go first.  An n-gram of three words
can occur in another shard only if both its pairs do, so only those are asked
for; for all others the shard's own count is the total.  Words go by 64-bit names; longer n-grams have ``NAME_BITS`` bits within their
bucket, so one in some 30,000 of them may share its count with another, which moves a score a little, but no word's count.  The
statistics for the weights are counts of (bucket, rounded estimates) cells,
a table of bounded size made from all training tokens.

Null and empty texts have the end token alone.  Rows without a doc_id are
held out.  Repeated ids are scored each for itself, repeated rows count as
often as they occur.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, pressed, restored, run_names, sharded, small_batches, unpacked, word_hashes

ORDER = 3
HELD_FOLDS = 10
#: Tokens of the corpus for each bucket of names.
BUCKET_TOKENS = 1 << 19
NAME_BITS = 34
EM_ROUNDS = 60
#: Frequency buckets, and steps of half a decade for an estimate (0: none).
FREQUENCIES, BINS = 24, 24
_END, _BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)

_REQUESTS = "bucket long, shard long, n_words int, n_grams int, words binary, grams binary, counts binary"
_REPLIES = "bucket long, shard long, n_words int, n_grams int, totals binary, n_types long, n_train long"
_TOLD = "shard long, totals array<binary>, asked array<struct<bucket:long,n_grams:int,grams:binary,counts:binary>>"
_COUNTED = "ids array<long>, held array<boolean>, lengths array<int>, n_known array<long>, base array<double>, counts array<binary>, cells array<long>, cell_counts array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _held(ids) -> np.ndarray:
    """Whether a document is held out."""
    return np.array([d is None or zlib.crc32(str(int(d)).encode()) % HELD_FOLDS == 0 for d in ids], bool)


def _optional(ids) -> list[int | None]:
    return [None if pd.isna(d) else int(d) for d in ids]


def token_names(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each order the 64-bit name of the n-gram that ends at each token, tokens of each text)."""
    words, counts = word_hashes(texts, lower=True)
    pad = order - 1
    stops = np.cumsum(counts)
    # each text: the words, then the end; before it as many begin marks as the order needs
    lengths = counts + 1
    total = int((lengths + pad).sum())
    padded = np.full(total, _BEGIN, np.uint64)
    ends = np.cumsum(lengths + pad)
    own = np.repeat(np.arange(len(texts)), counts)
    padded[np.arange(len(words)) + (ends - 1 - stops)[own]] = words
    padded[ends - 1] = _END
    real = np.ones(total, bool)
    first = ends - lengths - pad
    for k in range(pad):
        real[first + k] = False
    at = np.flatnonzero(real)
    return [padded[at], *(run_names(padded, k + 1)[at - k] for k in range(1, order))], lengths


def _short(names: np.ndarray, log_buckets: int) -> np.ndarray:
    return names >> np.uint64(64 - NAME_BITS - log_buckets)


def _asked(texts: list[bytes], order: int, log_buckets: int):
    """(distinct words, distinct pairs, for each of the two orders the place of each token's n-gram, names of three words, tokens of each text)."""
    names, lengths = token_names(texts, order)
    words, which = np.unique(names[0], return_inverse=True)
    pairs, at = np.zeros(0, np.uint64), []
    if order > 1:
        pairs, of_pairs = np.unique(_short(names[1], log_buckets), return_inverse=True)
        at = [of_pairs]
    return words, pairs, [which, *at], _short(names[2], log_buckets) if order > 2 else None, lengths


def _edges(names: np.ndarray, bits: int, log_buckets: int) -> np.ndarray:
    """Where each bucket's names begin, and the end."""
    return np.searchsorted(names >> np.uint64(bits), np.arange((1 << log_buckets) + 1, dtype=np.uint64))


def _gaps(names: np.ndarray, bits: int) -> bytes:
    return pressed(np.diff(names & np.uint64((1 << bits) - 1), prepend=np.uint64(0)))


def _requests(batches: Iterator[pd.DataFrame], order: int, log_buckets: int) -> Iterator[pd.DataFrame]:
    word_bits = 64 - log_buckets
    for pdf in batches:
        for shard, ids, sizes, packed in zip(pdf["shard"], pdf["ids"], pdf["sizes"], pdf["texts"], strict=True):
            words, pairs, which, _, lengths = _asked(unpacked(sizes, packed), min(order, 2), log_buckets)
            train = np.repeat(~_held(_optional(ids)), lengths)
            n_words = np.bincount(which[0][train], minlength=len(words))
            n_pairs = np.bincount(which[1][train], minlength=len(pairs)) if order > 1 else np.zeros(0, np.int64)
            of_words, of_pairs = _edges(words, word_bits, log_buckets), _edges(pairs, NAME_BITS, log_buckets)
            rows = []
            for k in range(1 << log_buckets):
                (a, b), (c, d) = of_words[k : k + 2], of_pairs[k : k + 2]
                if b > a or d > c:
                    rows.append((k, shard, b - a, d - c, _gaps(words[a:b], word_bits), _gaps(pairs[c:d], NAME_BITS), pressed(np.concatenate((n_words[a:b], n_pairs[c:d])))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REQUESTS.split(", ")])


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of a bucket and answer each shard."""
    n_words, n_grams = pdf["n_words"].to_numpy(), pdf["n_grams"].to_numpy()
    counts = [restored(c, n) for c, n in zip(pdf["counts"], n_words + n_grams, strict=True)]
    answers = []
    for column, sizes, parts in (("words", n_words, [c[:n] for c, n in zip(counts, n_words, strict=True)]), ("grams", n_grams, [c[n:] for c, n in zip(counts, n_words, strict=True)])):
        names = np.concatenate([np.cumsum(restored(x, n)) if n else np.zeros(0, np.uint64) for x, n in zip(pdf[column], sizes, strict=True)])
        distinct, which = np.unique(names, return_inverse=True)
        sums = np.bincount(which, np.concatenate(parts), len(distinct)).astype(np.int64)
        # the lowest bit: whether another shard has the name too
        answers.append(np.split((2 * sums + (np.bincount(which, minlength=len(distinct)) > 1))[which], np.cumsum(sizes)[:-1]))
        if column == "words":
            types, train = int((sums > 0).sum()), int(sums.sum())
    out = pdf[["bucket", "shard", "n_words", "n_grams"]].assign(totals=[pressed(np.concatenate(x)) for x in zip(*answers, strict=True)], n_types=0, n_train=0)
    out.iloc[0, out.columns.get_indexer(["n_types", "n_train"])] = (types, train)
    return out


def _before(a: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    """Each token's predecessor in its text; ``fill`` at the start."""
    out = np.empty_like(a)
    out[1:] = a[:-1]
    out[np.cumsum(lengths) - lengths] = fill
    return out


def _estimates(counts: list[np.ndarray], lengths: np.ndarray, texts: int, tokens):
    """(estimate of each order, context count of each order); ``counts``: of the n-gram at each token."""
    contexts = [np.broadcast_to(np.asarray(tokens), counts[0].shape)]
    for c in counts[:-1]:
        contexts.append(_before(c, lengths, texts))
    return [np.where(n > 0, c / np.maximum(n, 1), 0.0) for c, n in zip(counts, contexts, strict=True)], contexts


def _buckets(contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest order whose context occurs, frequency bucket of that context)."""
    longest, n = np.zeros(len(contexts[0]), np.int64), np.ones(len(contexts[0]), np.int64)
    for k, c in enumerate(contexts, 1):
        longest, n = np.where(c > 0, k, longest), np.where(c > 0, c, n)
    bucket = np.where(longest > 1, np.floor(np.log2(n)).astype(np.int64), 0)
    return longest, np.minimum(bucket, FREQUENCIES - 1)


def _replied(replies: pd.DataFrame, n_words: int, n_grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the words and of the longer n-grams that a shard asked for, and which of the latter other shards have too."""
    told = replies.astype({"n_words": "int64", "n_grams": "int64"}).sort_values("bucket")
    if told["n_words"].sum() != n_words or told["n_grams"].sum() != n_grams:
        raise ValueError("a bucket's answer is missing")
    totals = [restored(t, a + b).astype(np.int64) for t, a, b in zip(told["totals"], told["n_words"], told["n_grams"], strict=True)]
    none = [np.zeros(0, np.int64)]
    of_words, of_grams = (np.concatenate(none + [t[a:b] for t, a, b in parts]) for parts in ([(t, 0, n) for t, n in zip(totals, told["n_words"], strict=True)], [(t, n, None) for t, n in zip(totals, told["n_words"], strict=True)]))
    return of_words >> 1, of_grams >> 1, (of_grams & 1).astype(bool)


def _told(shards: pd.DataFrame, replies: pd.DataFrame, order: int, log_buckets: int) -> pd.DataFrame:
    """The totals of the shard's words and pairs, which tokens end an n-gram of three words that other shards may have too, and the requests for these."""
    out = []
    for shard, ids, sizes, packed in zip(shards["shard"], shards["ids"], shards["sizes"], shards["texts"], strict=True):
        words, pairs, which, threes, lengths = _asked(unpacked(sizes, packed), order, log_buckets)
        of_words, of_pairs, shared = _replied(replies, len(words), len(pairs))
        totals, asked = [pressed(of_words), pressed(of_pairs)], []
        if order > 2:
            train = np.repeat(~_held(_optional(ids)), lengths)
            elsewhere = shared[which[1]]
            ask = elsewhere & _before(elsewhere, lengths, True)
            totals.append(np.packbits(ask).tobytes())
            distinct, at = np.unique(threes[ask], return_inverse=True)
            counts = np.bincount(at[train[ask]], minlength=len(distinct))
            edges = _edges(distinct, NAME_BITS, log_buckets)
            asked = [{"bucket": k, "n_grams": b - a, "grams": _gaps(distinct[a:b], NAME_BITS), "counts": pressed(counts[a:b])} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        out.append((shard, totals, asked))
    return pd.DataFrame(out, columns=["shard", "totals", "asked"])


def _counted(shards: pd.DataFrame, told: pd.DataFrame, order: int, log_buckets: int, n_types: int, n_train: int, n_texts: int) -> pd.DataFrame:
    """``told`` has the row of ``_told`` (no bucket) and the replies to what it asked."""
    out = []
    for ids, sizes, packed in zip(shards["ids"], shards["sizes"], shards["texts"], strict=True):
        ids = _optional(ids)
        held = _held(ids)
        words, pairs, which, threes, lengths = _asked(unpacked(sizes, packed), order, log_buckets)
        n = len(which[0])
        train = np.repeat(~held, lengths)
        first = told[told["bucket"].isna()]["before"].iloc[0]
        counts = [restored(c, len(x)).astype(np.int64)[w] for c, x, w in zip(first, (words, pairs), which, strict=False)]
        if order > 2:
            distinct, at = np.unique(threes, return_inverse=True)
            which.append(at)
            total = np.bincount(at[train], minlength=len(distinct)).astype(np.int64)
            ask = np.unpackbits(np.frombuffer(first[2], np.uint8), count=n).astype(bool)
            asked = np.unique(at[ask])
            total[asked] = _replied(told[told["bucket"].notna()], 0, len(asked))[1]
            counts.append(total[at])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(doc, np.log10((counts[0] + 0.1) / (n_train + 0.1 * (n_types + 1))), len(lengths))
        known = np.bincount(doc, counts[0] > 0, len(lengths)).astype(np.int64)
        # what is left of the counts without the token's own document
        left = []
        for c, w in zip(counts, which, strict=True):
            _, pair, times = np.unique(doc * (int(w.max(initial=0)) + 1) + w, return_inverse=True, return_counts=True)
            left.append(c - np.where(train, times[pair], 0))
        estimates, contexts = _estimates(left, lengths, n_texts - 1, n_train - np.repeat(lengths, lengths))
        longest, frequency = _buckets(contexts)
        cell = longest * FREQUENCIES + frequency
        for p in estimates:
            step = np.where(p > 0, 1 + np.round(-2 * np.log10(np.maximum(p, 1e-300))), 0).astype(np.int64)
            cell = cell * BINS + np.minimum(step, BINS - 1)
        cells, times = np.unique(cell[train], return_counts=True)
        out.append((ids, held.tolist(), lengths.tolist(), known, base, [pressed(c) for c in counts], cells, times))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _COUNTED.split(", ")])


def learn_weights(cells: np.ndarray, times: np.ndarray, order: int, n_types: int) -> np.ndarray:
    """weights[longest order, frequency bucket, order]: expectation-maximisation within each bucket."""
    weights = np.zeros((order + 1, FREQUENCIES, order + 1))
    rest, estimates = cells.copy(), []
    for _ in range(order):
        step = rest % BINS
        rest //= BINS
        estimates.append(np.where(step > 0, 10.0 ** (-(step - 1) / 2), 0.0))
    p = np.stack([np.full(len(cells), 1 / (n_types + 1)), *estimates[::-1]], axis=1)
    longest, frequency = rest // FREQUENCIES, rest % FREQUENCIES
    for m in range(order + 1):
        for f in (None, *range(FREQUENCIES)):  # first all buckets together, the start of each
            own = (longest == m) & ((frequency == f) | (f is None))
            w = np.concatenate((np.full(m + 1, 1 / (m + 1)), np.zeros(order - m))) if f is None else weights[m, f].copy()
            prior = w.copy()
            if own.any():
                for _ in range(EM_ROUNDS):
                    share = p[own] * w
                    share *= (times[own] / share.sum(axis=1))[:, None]
                    w = share.sum(axis=0) + prior  # one token's worth of the prior keeps all orders in
                    w /= w.sum()
            weights[m, slice(None) if f is None else f] = w
    return weights


def _scores(batches: Iterator[pd.DataFrame], weights: np.ndarray, order: int, n_types: int, n_train: int, n_texts: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for ids, held, lengths, known, base, packed in zip(pdf["ids"], pdf["held"], pdf["lengths"], pdf["n_known"], pdf["base"], pdf["counts"], strict=True):
            lengths = np.asarray(lengths, np.int64)
            counts = [restored(c, int(lengths.sum())).astype(np.int64) for c in packed]
            estimates, contexts = _estimates(counts, lengths, n_texts, n_train)
            longest, frequency = _buckets(contexts)
            w = weights[longest, frequency]
            p = w[:, 0] / (n_types + 1)
            for k, e in enumerate(estimates, 1):
                p = p + w[:, k] * e
            score = np.bincount(np.repeat(np.arange(len(lengths)), lengths), np.log10(p), len(lengths))
            yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"), "held_out": held, "n_tokens": lengths, "n_known": known, "train_tokens": n_train, "base_score": base, "score": score})


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    shards = cut(sharded(rows))
    learned = F.expr(f"size(filter(ids, d -> coalesce(crc32(cast(d as string)) % {HELD_FOLDS} <> 0, false)))")
    about = shards.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum(learned), F.lit(0)).alias("texts")).first()
    log_buckets = min(24, max(4, int(np.ceil(np.log2(max(1, about["n"] / BUCKET_TOKENS))))))
    requests = shards.mapInPandas(lambda it: _requests(it, order, log_buckets), _REQUESTS)
    replies = cut(requests.groupBy("bucket").applyInPandas(_total, _REPLIES))
    n_types, n_train = replies.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    n_texts = about["texts"]
    told = cut(shards.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(lambda a, b: _told(a, b, order, log_buckets), _TOLD))
    free(replies)
    asked = told.select("shard", F.inline("asked")).select("bucket", "shard", F.lit(0).alias("n_words"), "n_grams", F.lit(None).cast("binary").alias("words"), "grams", "counts")
    answered = asked.groupBy("bucket").applyInPandas(_total, _REPLIES).select("shard", "bucket", "n_words", "n_grams", "totals", F.lit(None).cast("array<binary>").alias("before"))
    none = {"bucket": "long", "n_words": "int", "n_grams": "int", "totals": "binary"}
    both = told.select("shard", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("totals").alias("before")).unionByName(answered)
    counted = cut(shards.groupBy("shard").cogroup(both.groupBy("shard")).applyInPandas(lambda a, b: _counted(a, b, order, log_buckets, n_types, n_train, n_texts), _COUNTED))
    free(shards, told)
    cells = counted.select(F.explode(F.arrays_zip("cells", "cell_counts")).alias("c")).groupBy("c.cells").agg(F.sum("c.cell_counts").alias("n")).toPandas()  # bounded by FREQUENCIES and BINS
    weights = learn_weights(cells["cells"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), order, n_types)
    return counted.mapInPandas(lambda it: _scores(it, weights, order, n_types, n_train, n_texts), _SCORES)
