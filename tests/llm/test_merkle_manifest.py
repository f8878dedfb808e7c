import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from revlens.llm.merkle_manifest import build, fold, merkle_manifest, proof_digest, prove

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, idx long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, at, start, fanout=8):
    """The root over ``nodes`` with the one at ``at`` replaced, and the siblings on its way."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
        siblings += [x for i, x in enumerate(run) if i != at % fanout]
        start = h(*[start if i == at % fanout else x for i, x in enumerate(run)])
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], start, siblings


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    tops = [climb([leaf(r, r[1]) for r in groups[k]], 0, "")[0] for k in order]
    root = climb(tops, 0, "")[0]
    out = []
    for place, k in enumerate(order):
        leaves = [leaf(r, r[1]) for r in groups[k]]
        for i, r in enumerate(groups[k]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            subroot, folded, below = climb(leaves, i, leaf(r, text))
            _, folded, above = climb(tops, place, folded)
            out.append((r[0], leaves[i], subroot, root, h(*below, *above), folded, folded == root))
    return sorted(out, key=str)


def table(n, seed=1):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "Plain lower", "ÀÉ MiXeD ß", "A" * 3000, "no capitals", "\U0001f600 EMOJI\n"])
    rows = [(i * 3 - 5, text(), r.choice([None, "", "en", "en", "en", "de", "é", "ｚ", "\U00010000"]), r.choice([None, "s"]), r.choice([None, 7, -2]), "k", 1) for i in range(n)]
    return rows + [(None, "Null Id", "en", None, 1, "k", 2), (4, "TWICE", "en", "a", 1, "k", 3), (4, "TWICE", "en", "a", 1, "k", 4), (4, "other", "en", "a", 1, "k", 5), (9999, None, "lone", None, None, None, None)]


@pytest.mark.parametrize("n", [0, 150, 700])
def test_every_column_equals_a_plain_loop(spark, n):
    rows = table(n)
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([r[:5] for r in rows])


def test_one_document_and_none(spark):
    (row,) = merkle_manifest(spark.createDataFrame([(3, "Abc", "en", "s", 3, None, 1)], SCHEMA)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_group_of_many_and_many_of_one(spark):
    one = [(i, f"T{i}", "en", "s", i, None, 0) for i in range(513)]
    many = [(i, f"T{i}", f"l{i:04d}", "s", i, None, 0) for i in range(70)]
    for rows in (one, many):
        assert sorted([tuple(r) for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()], key=str) == brute([r[:5] for r in rows])


def test_other_fields_and_fanout(spark):
    df = spark.createDataFrame([(i, f"Row {i}", "a" if i % 3 else "b") for i in range(40)], "id long, body string, shelf string")
    proven = prove(df, "shelf", "id", ("id", "body"), fanout=3)
    out = proven.select("leaf", fold(F.col("leaf"), F.col("path")).alias("folded"), "root", proof_digest(F.col("path")).alias("proof")).collect()
    assert {r["folded"] for r in out} == {out[0]["root"]} and len({r["proof"] for r in out}) == 40


def test_each_level_is_an_eighth_and_in_order(spark):
    leaves = spark.range(1000).select(F.lit("g").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    store = build(leaves, [F.col("id")])
    assert [level.count() for level in store.levels] == [125, 16, 2, 1, 1]
    first = store.levels[0].orderBy("idx").first()
    assert [x["id"] for x in first["run"]] == list(range(8))
