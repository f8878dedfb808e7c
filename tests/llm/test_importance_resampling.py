import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from revlens.llm.importance_resampling import resample, ring, scan

SCHEMA = "doc_id long, text string, rank long, bucket string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, buckets, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x, n, buckets))
    for x in target:
        t.update(features(x, n, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, x in rows:
        f = features(x, n, buckets)
        w = sum(map(gain, f))
        u = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted([r for r in out if r[5] >= least], key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


def text(r, k):
    return " ".join(r.choice(["Alpha", "beta,", "naïve", "x1-y2", "日本", "ÀÉ", "the", "THE", "\x00\x01", "don't", f"w{r.randint(0, 300)}"]) for _ in range(k))


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (2, 70_000), (3, 64)])
def test_equals_a_plain_loop(spark, n, buckets):
    r = random.Random(n)
    rows = [(i, text(r, r.choice([0, 3, 19, 20, 60, 200]))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (2**60 + 1, text(r, 40)), (5, rows[5][1]), (5, rows[5][1]), (5, text(r, 30)), (None, text(r, 50)), (None, text(r, 50)), (1003, "word " * 50_000)]
    target = [text(r, 30) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*x, 1, "b") for x in rows], SCHEMA).repartition(4)
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resample(docs, aim, n, buckets).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows, target, n, buckets)


def test_empty_tables(spark):
    none, aim = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resample(none, aim).collect() == []
    rows = [(i, "a b c " * i) for i in range(30)]
    got = resample(spark.createDataFrame([(*x, 1, "b") for x in rows], SCHEMA), aim).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows, [], 1, 10_000)


def test_ring_extends_states_of_the_last_starts(spark):
    got = list(ring([b"a", b"bc", b"d"], 3))
    assert got == [zlib.crc32(x) for x in (b"a", b"bc", b"a bc", b"d", b"bc d", b"a bc d")]
    (row,) = scan(spark.createDataFrame([(1, "A bc", 1, "")], SCHEMA), 2, 1 << 20).collect()
    assert (row["n_words"], row["n_features"], len(row["buckets"])) == (2, 3, 12)
