import random
import re

import pytest

from revlens.llm.decontamination import blocks, decontaminated, find_contamination

DOCS, ITEMS = "doc_id long, text string, item_ids string, marks int", "item_id long, text string, doc_id long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    windows = {}
    for i, x in items:
        w = words(x)
        for a in range(max(1, len(w) - k + 1)) if w else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, x in docs:
        w, hit, named = words(x), set(), set()
        for size in {len(s) for s in windows}:
            for a in range(len(w) - size + 1):
                found = windows.get(tuple(w[a : a + size]))
                if found is not None:
                    hit.update(range(a, a + size))
                    named |= found - {None}
        out.append((d, len(w), len(hit), sorted(named)))
    return sorted(out, key=str)


def made(r):
    pool = [f"w{i}" for i in range(6)] + ["Éa", "日本", "X"]
    some = lambda n: [r.choice(pool) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 4, 10, 11, 30])))) for i in range(3, 15)] + [(15, "w1 w2"), (16, None), (17, " .,"), (None, "w3 w3 w3"), (3, " ".join(some(12))), (2**60, "only HERE")]
    items.append((18, items[4][1]))
    docs = []
    for d in range(120):
        w = some(r.choice([0, 5, 40]))
        for _ in range(r.randint(0, 2)):
            w[r.randint(0, len(w)) : 0] = words(r.choice(items)[1])
        docs.append((d, "".join(x.upper() + r.choice([" ", "\n", "--", ", ", "\x00"]) for x in w)))
    docs += [(500, None), (501, ""), (502, "?!"), (7, docs[7][1]), (None, "w1 w2 w2"), (2**60 + 1, "x " * 40_000 + "only here")]
    return docs, items


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_equals_a_plain_loop(spark, block_words):
    docs, items = made(random.Random(block_words))
    df = spark.createDataFrame([(*x, "n", 1) for x in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = find_contamination(df, bench, block_words=block_words).collect()
    assert sorted([(x["doc_id"], x["n_words"], x["n_hit"], x["item_ids"]) for x in got], key=str) == brute(docs, items)
    texts = dict(docs)
    for x in got:
        if x["doc_id"] is not None and x["doc_id"] != 7:
            assert sum(len(words(texts[x["doc_id"]][s["start"] : s["stop"]])) for s in x["spans"]) == x["n_hit"]


def test_spans_are_code_points_of_the_original(spark):
    docs = spark.createDataFrame([(1, "\U0001f600 é ONE, Two  three. Four", "n", 1), (2, "one two", "n", 1)], DOCS)
    bench = spark.createDataFrame([(9, "one two three", 1), (4, "four!", 1), (4, "four", 1)], ITEMS)
    first, second = find_contamination(docs, bench).orderBy("doc_id").collect()
    assert [("\U0001f600 é ONE, Two  three. Four"[s["start"] : s["stop"]]) for s in first["spans"]] == ["ONE, Two  three. Four"]
    assert first["item_ids"] == [4, 9] and second["spans"] == []


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "n", 1)], DOCS), spark.createDataFrame([], ITEMS)
    (row,) = decontaminated(docs, none).collect()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (2, 0, 0, False)
    assert decontaminated(spark.createDataFrame([], DOCS), none).collect() == []


def test_blocks_hold_every_window_of_long_items(spark):
    text = " ".join(f"w{i % 977}" for i in range(5_000))
    bench = spark.createDataFrame([(1, text, 1), (2, "short one", 1)], ITEMS)
    found = list(blocks(bench, block_words=700))
    assert len(found) > 5 and all(sum(len(w) for _, w in b) <= 1_400 or len(b) == 1 for b in found)
    windows = {tuple(w[a : a + 10]) for b in found for i, w in b if i == 1 for a in range(len(w) - 9)}
    w = text.split()
    assert windows == {tuple(w[a : a + 10]) for a in range(len(w) - 9)}
