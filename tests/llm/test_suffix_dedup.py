import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from revlens.llm.suffix_dedup import FILED_BYTES, column_wise_order, dedup_suffixes


def brute(rows, width=100):
    texts = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for d, b in texts:
        gone = set()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if d is not None:
                if w in seen:
                    gone.update(range(i, i + width))
                seen.add(w)
        spans = sum(i - 1 not in gone for i in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_column_wise_order_sorts_all_suffixes(pieces):
    piece, length = column_wise_order(pieces)
    got = [(pieces[p][len(pieces[p]) - n :]) for p, n in zip(piece, length)]
    assert got == sorted(p[i:] for p in pieces for i in range(len(p) + 1))


def rows_with_repeats():
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcde fé\n") for _ in range(n))
    passages = [prose(r.randint(90, 400)) for _ in range(5)]
    rows = []
    for d in range(90):
        t = ""
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            t += r.choice(passages)[r.randint(0, 60) :] if kind < 0.5 else "=" * r.randint(1, 300) if kind < 0.6 else "ab" * r.randint(1, 150) if kind < 0.7 else prose(r.randint(1, 200))
        rows.append((d * 7 % 97, t))
    return rows + [(200 + i, rows[11][1]) for i in range(3)] + [(300, None), (301, ""), (None, rows[3][1])]


def test_repeats_against_brute_force(spark):
    rows = rows_with_repeats()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    want = brute(rows)
    assert sorted((tuple(r) for r in dedup_suffixes(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in dedup_suffixes(df, hot_anchor=3).collect()), key=str) == want


def test_empty_table(spark):
    assert dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_column_wise_order_of_bytes_of_all_values_over_several_blocks():
    r = random.Random(9)
    pieces = [bytes(r.choice((0, 65, 66, 255, r.randrange(256))) for _ in range(r.choice((0, 1, 30, 90)))) for _ in range(40)]
    pieces += [pieces[-1], b"A" * 700, bytes(range(256)) * 2]
    piece, length = column_wise_order(pieces)
    got = [(pieces[p][len(pieces[p]) - n :]) for p, n in zip(piece, length)]
    assert got == sorted(p[i:] for p in pieces for i in range(len(p) + 1))
    assert sorted(zip(piece.tolist(), length.tolist())) == [(p, n) for p, x in enumerate(pieces) for n in range(len(x) + 1)]
    for empty in ([], [b""], [b"", b""]):
        assert column_wise_order(empty)[1].tolist() == [0] * len(empty)


def test_a_column_sorts_nothing_of_the_transform(monkeypatch):
    sorts = []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sorts.append(len(a)) or real(a, *args, **kw))
    column_wise_order([b"abracadabra" * 20] * 3)
    assert sum(sorts) <= 2 * 3 * (220 + 1)


def test_text_of_several_slices(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcd é\n") for _ in range(3 * FILED_BYTES))
    rows = [(1, long[:90000]), (2, long[50000:300000] + long[:500]), (3, "x" * 250 + long[200000:210000]), (4, "é" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in dedup_suffixes(df).collect()), key=str) == brute(rows)
