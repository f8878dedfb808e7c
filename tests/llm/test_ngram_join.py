import random
import re

from revlens.llm.ngram_join import jaccard_components


def shingles(t):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(sets[d]) if d is not None else 0, find(d) if d is not None else None) for d, _ in rows), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == brute(rows)


def test_against_brute_force(spark):
    r = random.Random(11)
    word = lambda: str(r.randint(0, 400))
    common = [word() for _ in range(40)]
    rows, d = [], 0
    for _ in range(40):
        base = [word() for _ in range(r.randint(1, 120))]
        if r.random() < 0.4:
            base = common + base
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            rows.append(((d * 37) % 1009, " ".join(w)))
            d += 1
    check(spark, rows)


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "  "), (4, "A b"), (5, "a B"), (6, "a b c"), (None, "a b"), (7, "x " * 900), (8, "X " * 20)])
    check(spark, [])


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    one, two = " ".join(f"p{i}" for i in range(6)), " ".join(f"q{i}" for i in range(6))
    check(spark, [(1, f"{one} {a} {two}"), (2, f"{one} {b} {two}"), (3, a), (4, b)])


def test_hub_with_many_partners_and_a_common_line(spark):
    r = random.Random(5)
    word = lambda: str(r.randint(0, 10**6))
    base, line = [word() for _ in range(60)], " ".join(word() for _ in range(12))
    rows = [(0, " ".join(base))]
    for d in range(1, 700):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    rows += [(d, f"{line} {' '.join(word() for _ in range(r.randint(1, 6)))}") for d in range(700, 760)]
    check(spark, rows)


def test_repeated_ids(spark):
    long, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    rows = [(5, long), (5, other), (5, other), (7, long), (9, other), (9, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(df).collect())
    assert got == sorted([(5, 16, 5)] * 3 + [(7, 16, 5), (9, 16, 5), (9, 0, 5), (11, 0, 11)])
