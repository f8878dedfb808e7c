import math
import re

from revlens.llm.quality_rules import distance, judge_quality

import numpy as np


def repeats(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return sum(any(three.count(three[j]) > 1 for j in range(max(0, i - 2), min(i, len(three) - 1) + 1)) for i in range(len(w)))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = [f"p q {a} r s p q {b} r s", "x y z x y z", f"m {a} n m {a} n"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in judge_quality(df).collect()}
    assert got == {i: repeats(t) for i, t in enumerate(texts)} and got[0] == 0


def test_distance_by_its_definition():
    def js(p, q):
        m = [(x + y) / 2 for x, y in zip(p, q)]
        kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m) if x > 0)
        return math.sqrt((kl(p) + kl(q)) / 2)

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    assert math.isclose(float(distance(np.array([p]), np.array(q))[0]), js(p, q), rel_tol=1e-9)
