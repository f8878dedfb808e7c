import os
import random

import numpy as np
import pytest

from revlens.llm.common import byte_names, cut, free, pressed, range_names, restored, run_names, sharded, unpacked, word_hashes
from revlens.llm.components import components


def test_names_tell_contents_apart():
    r = random.Random(2)
    words = {"".join(r.choice("ab\0") for _ in range(r.randint(0, 30))).encode() for _ in range(3000)} | {b"a" * n for n in range(1, 200)}
    words = sorted(words)
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    names = byte_names(data, start, end)
    assert len(set(names.tolist())) == len(words)
    assert (byte_names(data, start, end, salt=1) != names).all()
    # the same bytes have the same name wherever they stand
    moved = byte_names(np.concatenate((np.zeros(5, np.uint8), data)), start + 5, end + 5)
    assert (moved == names).all()


def test_runs_and_ranges():
    r = random.Random(3)
    symbols = np.array([r.choice((7, 9)) for _ in range(400)], np.uint64)
    for k in (1, 2, 5, 13):
        names, contents = run_names(symbols, k), [tuple(symbols[i : i + k]) for i in range(len(symbols) - k + 1)]
        assert len(names) == len(contents) and len(set(names.tolist())) == len(set(contents)) == len(set(zip(names.tolist(), contents)))
    spans = [(a, a + r.randint(1, 9)) for a in range(0, 390)]
    names = range_names(symbols, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    contents = [tuple(symbols[a:b]) for a, b in spans]
    assert len(set(names.tolist())) == len(set(contents)) == len(set(zip(names.tolist(), contents)))
    assert len(run_names(symbols[:2], 3)) == 0


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256, 65536], [2**63 + 5, 0, 7]])
def test_pressed_values_come_back(values):
    a = np.array(values, np.uint64)
    assert restored(pressed(a), len(a)).tolist() == values


def test_shards_hold_all_texts(spark):
    rows = [(i, "word " * (i % 50)) for i in range(200)] + [(None, None)]
    got = []
    for shard in sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got += list(zip(shard["ids"], unpacked(shard["sizes"], shard["texts"])))
    assert sorted(got, key=str) == sorted([(d, (t or "").encode()) for d, t in rows], key=str)
    assert word_hashes([b"A b", b""], lower=True)[1].tolist() == [2, 0]


def test_cut_writes_and_free_deletes(spark):
    table = cut(spark.range(5).selectExpr("id", "cast(null as string) as s"))
    (folder,) = {os.path.dirname(f.removeprefix("file:")) for f in table.inputFiles()}
    assert table.count() == 5 and table.dtypes == [("id", "bigint"), ("s", "string")] and os.path.exists(folder)
    free(table)
    assert not os.path.exists(folder)
    free(spark.range(1))  # a table of someone else's is left alone


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 300)]
    loops = [(500, 500), (600, 601), (601, 600), (600, 601)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in chain + star + loops]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}, 600: 600, 601: 600}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
