import collections
import math
import random
import re
import zlib

import numpy as np

from revlens.llm.interpolation_lm import BINS, FREQUENCIES, learn_weights, score_texts


def tokens(t):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())] + [None]


def is_held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        at, out = r.randrange(60), []
        for _ in range(r.randint(0, 60)):
            out.append(words[at].upper() if r.random() < 0.2 else words[at])
            at = (at * 7 + r.choice([1, 1, 1, 2, 5])) % 60
        rows.append((d, " ".join(out)))
    return rows + [(500, None), (501, ""), (None, "w1 w2"), (502, "new words É only"), (3, rows[3][1])]


def test_base_and_probabilities(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    got = {(r["doc_id"], r["n_tokens"]): r for r in score_texts(df).collect()}
    count = collections.Counter(x for d, t in rows if not is_held(d) for x in tokens(t))
    total, types = sum(count.values()), len(count)
    better = 0.0
    for d, t in rows:
        x = tokens(t)
        r = got[d, len(x)]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (is_held(d), sum(w in count for w in x), total)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in x)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert -400 < r["score"] < 0
        better += (r["score"] - base) * is_held(d)
    assert better > 0  # held-out texts are likelier than under single words
    assert score_texts(df.limit(0)).collect() == []


def test_weights_sum_to_one_and_follow_the_cells():
    # one bucket: the order-2 estimate is always right, the others are not
    good = ((2 * FREQUENCIES + 3) * BINS + 9) * BINS + 1
    weights = learn_weights(np.array([good]), np.array([1000]), 2, 99)
    assert np.allclose(weights.sum(axis=2), 1)
    assert weights[2, 3, 2] > 0.95 and (weights[2, 3] > 0).all()


def test_contexts_of_two_words_count(spark):
    r = random.Random(6)
    rows = [(d, " ".join(r.choice(["a x b", "c x d"]) for _ in range(30))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda scored: sum(x["score"] for x in scored.where("held_out").collect())
    assert total(score_texts(df)) > total(score_texts(df, 2)) + 1


def brute_scores(rows, order=3):
    """Every count and estimate by hand; only the learning of the weights is the operator's own."""
    padded = lambda t: [b"<"] * (order - 1) + tokens(t)
    grams = lambda t, k: [tuple(padded(t)[i - k : i + 1]) for i in range(order - 1, len(padded(t)))]
    learned = [t for d, t in rows if not is_held(d)]
    count = [collections.Counter(g for t in learned for g in grams(t, k)) for k in range(order)]
    n_train, n_types, n_texts = sum(count[0].values()), len(count[0]), len(learned)

    def looked_up(t, own):
        """(estimates, longest order, frequency bucket) of each token, without the counts of ``own``."""
        less = [collections.Counter(grams(t, k)) if own else collections.Counter() for k in range(order)]
        c = [[count[k][g] - less[k][g] for g in grams(t, k)] for k in range(order)]
        out = []
        for i in range(len(tokens(t))):
            context = [n_train - (len(tokens(t)) if own else 0)] + [c[k - 1][i - 1] if i else n_texts - own for k in range(1, order)]
            longest = max((k for k in range(1, order + 1) if context[k - 1] > 0), default=0)
            bucket = int(math.log2(context[longest - 1])) if longest > 1 else 0
            out.append(([c[k][i] / context[k] if context[k] > 0 else 0.0 for k in range(order)], longest, bucket))
        return out

    cells = collections.Counter()
    for t in learned:
        for estimates, longest, bucket in looked_up(t, True):
            cell = longest * FREQUENCIES + bucket
            for p in estimates:
                cell = cell * BINS + (min(BINS - 1, 1 + round(-2 * math.log10(p))) if p > 0 else 0)
            cells[cell] += 1
    w = learn_weights(np.array(list(cells)), np.array(list(cells.values())), order, n_types)
    return [sum(math.log10(w[m, f, 0] / (n_types + 1) + sum(w[m, f, k + 1] * p for k, p in enumerate(e))) for e, m, f in looked_up(t, False)) for _, t in rows]


def test_scores_by_hand(spark):
    rows = [r for r in corpus() if r[0] != 3]
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, _), want in zip(rows, brute_scores(rows)):
        assert math.isclose(got[d], want, rel_tol=1e-6, abs_tol=1e-6)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(d, f"x {a}") for d in range(1, 30)] + [(100, f"y {b}")]
    held = next(d for d in range(1000, 2000) if is_held(d))
    rows = [r for r in rows if not is_held(r[0]) and r[0] != 100] + [(held, f"x {b}")]
    got = {r["doc_id"]: r["n_known"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held] == 2 and set(got[d] for d, _ in rows[:-1]) == {3}


def test_several_shards(spark, monkeypatch):
    rows = corpus()
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    many = {(r["doc_id"], r["n_tokens"]): r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)
