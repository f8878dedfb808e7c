"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters.  A token's emission is the sum of the weights
of its features (the word, and its first 4 to 7 bytes); two states, clean
and toxic, follow each other with learned potentials.  Forward-backward
gives the marginal of every token; a document's score is a logistic
function of its largest and its summed marginals, and runs of tokens with a
marginal of one half or more are the offending spans.

Training takes a bounded sample of labelled documents (``MAX_DOCS`` of each
label and at most ``MAX_CHARS`` long, chosen by a hash of the id).  Token
labels come from document labels: a token of a toxic document is toxic if
one of its features is much more frequent in toxic documents.  Only the
sample reaches the driver; every whole text is scored on the executors.

Null and empty texts have no token and get the score of an empty text.
Rows without a doc_id are scored, count as held out, and are never learned
from.  Repeated labels of one id count once, as toxic if any is.  Without
labels of both kinds the score is the smoothed share of toxic labels and
there are no spans.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, encoded, mix, slices, span_hashes, split_words

FOLDS = 5
#: The training sample: documents of each label, and their greatest length.
MAX_DOCS, MAX_CHARS = 1_000, 20_000
#: Features in fewer documents are left out; a telling one has at least these log-odds, two standard errors below its estimate.
MIN_DOCS, MIN_LOG_ODDS = 3, 1.5
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, DECAY = 25, 0.5, 1e-3

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[ord("a") : ord("z") + 1] = _GAP[ord("A") : ord("Z") + 1] = False


class Model(NamedTuple):
    names: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    step: np.ndarray  # 2 x 2 potentials
    first: float  # potential of a toxic first token
    rule: np.ndarray  # logistic: constant, largest marginal, log of one plus the sum of those of one half or more


class Tokens(NamedTuple):
    data: np.ndarray  # the texts' bytes, with the places of the tokens
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray  # tokens of each text
    words: np.ndarray  # distinct words by their features (words x features)
    which: np.ndarray  # the word of each token


def tokens_of(texts: list[bytes]) -> Tokens:
    data, start, end, counts = split_words(texts, gap=_GAP)
    low = _LOWER[data]
    names = span_hashes(_BYTE[low], start, end)
    distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
    s, n = start[first], (end - start)[first]
    columns, packed = [distinct], np.zeros(len(s), np.uint64)
    for k in range(max(PREFIXES)):
        packed |= np.where(k < n, low[np.minimum(s + k, len(low) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            columns.append(np.where(n > k + 1, mix(packed ^ np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0)))
    return Tokens(data, start, end, counts, np.stack(columns, axis=1), which)


def _sample(texts: list[bytes]) -> Tokens:
    """The tokens of the training sample, made a slice at a time, without the texts."""
    words, which, counts, n = [], [], [], 0
    for a, b in slices(texts):
        t = tokens_of(texts[a:b])
        words.append(t.words)
        which.append((t.which + n).astype(np.int32))
        counts.append(t.counts)
        n += len(t.words)
    every = np.concatenate(words)
    _, first, same = np.unique(every[:, 0], return_index=True, return_inverse=True)
    none = np.zeros(0, np.int64)
    return Tokens(none, none, none, np.concatenate(counts), every[first], same[np.concatenate(which)].astype(np.int32))


def _recursion(start: np.ndarray, at_start: float, step: np.ndarray, gain_before: np.ndarray, gain_after: np.ndarray) -> np.ndarray:
    """x[t] = gain_after[t] * (s01 + s11 y) / (s00 + s10 y), y = gain_before[t] * x[t-1]; at ``start`` the fraction is ``at_start``.

    Runs over blocks side by side; each pass hands every block the end of
    the one before, until nothing changes.
    """
    n = len(start)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    shape = lambda a, fill: np.concatenate((a, np.full(rows * width - n, fill, a.dtype))).reshape(rows, width).T.copy()
    start, before, after = shape(start, True), shape(gain_before, 1.0), shape(gain_after, 1.0)
    x, out = np.ones(rows), np.empty((width, rows))
    for _ in range(rows + 1):
        seed = x.copy()
        for k in range(width):
            y = x * before[k]
            x = np.where(start[k], at_start, (step[0, 1] + step[1, 1] * y) / (step[0, 0] + step[1, 0] * y)) * after[k]
            out[k] = x
        x = np.concatenate(([1.0], out[-1, :-1]))
        if np.allclose(x, seed, rtol=1e-12, atol=0):
            break
    return out.T.reshape(-1)[:n]


def marginals(emission: np.ndarray, counts: np.ndarray, step: np.ndarray, first: float):
    """(probability of toxic for each token, forward ratios, backward ratios, gains, starts)."""
    gain = np.exp(np.clip(emission, -30, 30))
    start = np.zeros(len(gain), bool)
    start[(np.cumsum(counts) - counts)[counts > 0]] = True
    one = np.ones(len(gain))
    ahead = _recursion(start, first, step, one, gain)
    # backwards, the message into t - 1 is made of the gain and the message at t
    last = np.concatenate((start[1:], [True]))[::-1]
    behind = _recursion(last, 1.0, step.T, np.concatenate(([1.0], gain[::-1][:-1])), one)[::-1]
    both = ahead * behind
    return both / (1 + both), ahead, behind, gain, start


def emissions(model: Model, tokens: Tokens) -> np.ndarray:
    if not len(model.names):
        return np.zeros(len(tokens.which))
    place = np.minimum(np.searchsorted(model.names, tokens.words), len(model.names) - 1)
    return np.where(model.names[place] == tokens.words, model.weights[place], 0.0).sum(axis=1)[tokens.which]


def _document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    sums = np.concatenate(([0.0], np.cumsum(np.where(p >= 0.5, p, 0))))
    largest = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, first[some])
    return np.stack([np.ones(len(counts)), largest, np.log1p(np.maximum(sums[first + counts] - sums[first], 0))], axis=1)


def _fit_rule(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
    return b


def train(texts: list[bytes], toxic: np.ndarray, totals: tuple[int, int]) -> Model:
    """Fit the field and the document rule; ``totals``: how many documents bear the labels 0 and 1."""
    none = np.zeros(0, np.uint64)
    if not len(texts) or toxic.all() or not toxic.any():
        share = (totals[1] + 0.5) / (totals[0] + totals[1] + 1)
        return Model(none, np.zeros(0), np.ones((2, 2)), 1.0, np.array([np.log(share / (1 - share)), 0, 0]))
    t = _sample(texts)
    doc = np.repeat(np.arange(len(texts)), t.counts)
    # document frequency of each feature among the two labels
    pair = np.unique(doc * len(t.words) + t.which)
    pair_doc, pair_word = pair // len(t.words), pair % len(t.words)
    flat, owner = t.words[pair_word].ravel(), np.repeat(pair_doc, t.words.shape[1])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))) & (flat > 0)
    names, at = np.unique(flat[new], return_inverse=True)
    seen = [np.bincount(at[toxic[owner[new]] == v], minlength=len(names)) for v in (0, 1)]
    used = seen[0] + seen[1] >= MIN_DOCS
    names, seen = names[used], [s[used] for s in seen]
    n = [(toxic == v).sum() for v in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    telling = odds - 2 * error > MIN_LOG_ODDS
    place = np.minimum(np.searchsorted(names, t.words), max(len(names) - 1, 0))
    known = names[place] == t.words if len(names) else np.zeros(t.words.shape, bool)
    marked = (known & (telling[place] if len(names) else False)).any(axis=1)
    y = (marked[t.which] & toxic[doc].astype(bool)).astype(float)

    weights, theta, first = np.zeros(len(names) + 1), np.zeros((2, 2)), 0.0
    slot = np.where(known, place, len(names))  # the last slot stays zero
    sums = [np.full_like(weights, 1e-8), np.full((2, 2), 1e-8), 1e-8]
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    inner = np.ones(len(doc), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    pairs = np.bincount((y[inner - 1] * 2 + y[inner]).astype(int), minlength=4).reshape(2, 2)
    for _ in range(STEPS):  # Adagrad on the log-likelihood of the sample
        step = np.exp(theta)
        emission = weights[slot].sum(axis=1)[t.which]
        p, ahead, behind, gain, _ = marginals(emission, t.counts, step, float(np.exp(first)))
        per_word = np.bincount(t.which, y - p, len(t.words))
        grad = np.bincount(slot.ravel(), np.repeat(per_word, slot.shape[1]), len(weights)) - DECAY * len(texts) * weights
        grad[-1] = 0
        joint = np.stack([np.ones(len(inner)) * step[0, 0], step[0, 1] * gain[inner] * behind[inner], ahead[inner - 1] * step[1, 0], ahead[inner - 1] * step[1, 1] * gain[inner] * behind[inner]])
        grad_theta = pairs - (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad_theta[0, 0] = 0
        grad_first = float((y[starts] - p[starts]).sum())
        grads = (grad, grad_theta, grad_first)
        sums = [s + g * g for s, g in zip(sums, grads, strict=True)]
        weights, theta, first = (v + RATE * g / np.sqrt(s) for v, g, s in zip((weights, theta, first), grads, sums, strict=True))
    keep = np.abs(weights[:-1]) > 1e-3
    model = Model(names[keep], weights[:-1][keep], np.exp(theta), float(np.exp(first)), np.zeros(3))
    p = marginals(emissions(model, t), t.counts, model.step, model.first)[0]
    share = np.array([totals[0] / n[0], totals[1] / n[1]])
    weight = share[toxic.astype(int)] / (share @ n / len(texts))
    return model._replace(rule=_fit_rule(_document_features(p, t.counts), toxic.astype(float), weight))


def _scored(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids, held = encoded(pdf["text"]), pdf["doc_id"].array, pdf["held_out"].array
        for a, b in slices(texts):
            t = tokens_of(texts[a:b])
            p = marginals(emissions(model, t), t.counts, model.step, model.first)[0] if len(t.which) else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(_document_features(p, t.counts) @ model.rule, -30, 30)))
            spans = np.full(b - a, "", object)
            hit = np.flatnonzero(p >= 0.5) if len(model.names) else np.zeros(0, np.int64)
            if len(hit):
                doc = np.repeat(np.arange(b - a), t.counts)
                chars = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
                base = chars[np.cumsum([0, *(len(x) + 1 for x in texts[a:b])])]
                head = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)))
                tail = np.concatenate((np.flatnonzero(head)[1:] - 1, [len(hit) - 1]))
                for i, j in zip(hit[head], hit[tail], strict=True):
                    d = doc[i]
                    spans[d] += f"{',' if spans[d] else ''}{chars[t.start[i]] - base[d]}:{chars[t.end[j]] - base[d]}"
            yield pd.DataFrame({"doc_id": ids[a:b], "held_out": held[a:b], "score": score, "predicted": (score >= 0.5).astype(np.int32), "spans": spans})


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the labelled rows that are not held out: a bounded sample of them, chosen by a hash."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(toxic > 0)")).alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = docs.where(F.length("text") <= MAX_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"))
    present = marked.join(ids, "doc_id", "left_semi")
    sample = reduce(DataFrame.union, (present.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS) for v in (0, 1)))
    # at most 2 * MAX_DOCS ids, so the texts need no exchange
    rows = docs.where(F.length("text") <= MAX_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    picked = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    return train(encoded([r["text"] for r in picked]), np.array([r["toxic"] for r in picked], np.int64), (totals.get(0, 0), totals.get(1, 0)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, spans (start:end in code points, comma-joined)."""
    model = learn(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % FOLDS == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInPandas(lambda it: _scored(it, model), "doc_id long, held_out boolean, score double, predicted int, spans string")
