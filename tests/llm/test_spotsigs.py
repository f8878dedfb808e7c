import hashlib
import random
import re

from revlens.llm.spotsigs import ANCHORS, CHAIN, SPAN, fingerprint_documents, likeness


def sigs(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    out = set()
    for i, a in enumerate(w):
        if a in ANCHORS:
            c = [x for x in w[i + 1 : i + 1 + SPAN] if x not in ANCHORS][:CHAIN]
            if c:
                out.add((a, *c))
    return out or ({("whole", *w)} if w else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    got = {r["doc_id"]: r for r in fingerprint_documents(df).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r["fingerprint"]) == 8 * len(sigs(t)) and len(r["edited_fingerprint"]) == 8 * len(sigs(edited))
        assert abs(r["near_edited"] - like(sigs(t), sigs(edited))) < 1e-12
        assert abs(r["near_next"] - like(sigs(t), sigs(after))) < 1e-12
    return got


def test_against_plain_python(spark):
    r = random.Random(8)
    words = [*ANCHORS[:20], "haus", "Größe", "river", "stone", "x1", "café", "night", "tower", "green"]
    rows = [(d * 13 % 1009, r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 80)))) for d in range(300)]
    got = check(spark, rows)
    assert max(len(x["fingerprint"]) for x in got.values()) > 100


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, "!!"), (4, "no anchors here"), (5, "no anchors here"), (None, "the last one"), (-7, "the first of all é")])
    check(spark, [(1, "the only document of all")])
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same = spark.createDataFrame([(3, "the same words")] * 5, "doc_id long, text string")
    assert [r["near_next"] for r in fingerprint_documents(same).collect()] == [1.0] * 5


def test_pruned_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3]), ([1, 2, 3, 4], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(likeness(df.a, df.b, 0.75)).collect()] == [0.75, 0.0]
