import hashlib
import random
import re

from revlens.llm.recompression import dedup_substrings


def brute(rows, width=13):
    words = [(d, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in dedup_substrings(df).collect()), key=str)
    assert got == brute(rows)


def test_random_repeats_runs_and_copies(spark):
    r = random.Random(3)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(13, 60))] for _ in range(6)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.4:
                p = r.choice(passages)
                w += p[r.randint(0, 5) :]
            elif kind < 0.6:
                w += [r.choice("ab")] * r.randint(1, 40)
            elif kind < 0.7:
                w += ["a", "b"] * r.randint(1, 20)
            else:
                w += [str(r.randint(0, 50)) for _ in range(r.randint(1, 30))]
        rows.append((d * 3 % 151, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(500 + i, rows[7][1]) for i in range(5)]
    check(spark, rows)


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a " * 30), (4, "a " * 30), (5, "a " * 13), (5, "a " * 13), (6, long), (7, "x " + long), (8, "é ü x " * 9)]
    check(spark, rows)
    check(spark, [])
