import itertools
import random
import zlib

import numpy as np

from revlens.llm.toxicity_crf import marginals, score_toxicity


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    counts = np.array([3, 0, 5, 1, 6])
    emission, step, first = r.normal(0, 2, counts.sum()), np.exp(r.normal(0, 1, (2, 2))), 0.4
    got = marginals(emission, counts, step, first)[0]
    at = 0
    for n in counts:
        total, ones = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)) if n else ():
            w = first if path[0] else 1.0
            w *= np.prod([step[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(e for e, y in zip(emission[at : at + n], path) if y))
            total += w
            ones += w * np.array(path)
        assert np.allclose(got[at : at + n], ones / total if n else [])
        at += n


def test_held_out_accuracy_and_spans(spark):
    r = random.Random(7)
    words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(600)]
    bad = ["slurry", "slurrish", "nastyword", "vileness"]
    rows, labels = [], []
    for d in range(900):
        toxic = d % 6 == 0
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(2, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad).upper() if r.random() < 0.3 else r.choice(bad))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "é slurry, nastyword! vileness"), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = score_toxicity(df, lab).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    held = [x for x in out if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (x["doc_id"] is None or zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held) > 50
    none = next(x for x in out if x["doc_id"] is None)
    assert none["predicted"] == 1 and none["spans"] in ("2:8,10:19,21:29", "2:29", "2:8,10:29", "2:19,21:29")
    assert all(0 <= x["score"] < 0.5 for x in out if x["doc_id"] in (5000, 5001))
    # without labels of both kinds, and without rows
    plain = score_toxicity(df, lab.where("toxic = 0")).collect()
    assert len({x["score"] for x in plain}) == 1 and not any(x["spans"] for x in plain)
    assert score_toxicity(df.limit(0), lab).collect() == []
