import collections
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from revlens.llm.packing import WordEncoder, pack, tokenizer_path, windows


def check(spark, rows, capacity, block, partitions=3):
    t = Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, start int").repartition(partitions)
    got = pack(df, capacity=capacity, block=block).collect()
    ids = collections.defaultdict(list)
    for d, x in rows:
        ids[d].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for d, all_ids in ids.items():
        assert sum(r["length"] for r in pieces[d]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(all_ids[0]))
                assert r["ids_crc32"] == zlib.crc32(all_ids[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(all_ids[0])
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return got, sequences


def test_every_id_once_and_little_padding(spark):
    r = random.Random(3)
    word = lambda: r.choice(["The", "haus,", "naïve", "x1-y2", "日本", "<b>", "don't", "A.B.", "RUNNING", "it's...", "100,000", "über", " ", "<|endoftext|>"]) if r.random() < 0.5 else "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 9)))
    rows = [(d, r.choice([" ", "\n", "  \t"]).join(word() for _ in range(r.choice([0, 1, 5, 40, 200, 700])))) for d in range(400)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "é" * 2000), (None, "no id here"), (5, rows[5][1])]
    got, sequences = check(spark, rows, 256, 64)
    full = sum(x["length"] for x in got)
    padded = sum(256 if (n := sum(x["length"] for x in s)) & (n - 1) else n for s in sequences.values())
    assert padded < 1.06 * full


def test_small_and_empty(spark):
    check(spark, [(1, "one two three four five six seven"), (2, "")], 4096, 256, 1)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_window_count_rises_only_when_needed():
    sizes = [8, 7, 6, 5, 4]  # differencing into two gives 16 and 14
    assert sorted(sum(sizes[i] for i in w) for w in windows(sizes, 16)) == [14, 16]
    assert len(windows(sizes, 15)) == 3
    assert len(windows([6, 6, 6], 9)) == 3
    assert windows([], 9) == []


def test_greek_capitals_and_unusual_case(spark):
    texts = ["ΟΔΟΣ ΣΑΣ Σ.", "ΣΑΣ, σας ΣΊΣΥΦΟΣ; Σ", "İSTANBUL ǅ ẞ STRASSE Straße", "ΑΣ' Σ-Σ ΣΣ"]
    check(spark, list(enumerate(texts)), 64, 4)


def test_forms_of_a_word_are_encoded_once():
    e = WordEncoder(tokenizer_path())
    texts = ["Haus haus, HAUS*** (haus). «Haus»", "ÉCOLE école; École!? l'école", "x<|endoftext|>y <|a a|> 10 01 ÷×"]
    for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
        assert list(ids) == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert sum(b"haus" in w for w in e.index) == 1
    assert sorted(w for w in e.index if "école".encode() in w) == ["l'école".encode(), "école".encode()]


def test_odd_characters_against_the_tokenizer():
    r = random.Random(7)
    atoms = [*"abXY09 \t\n\x0b.,'!*|<>éÀßÿ×÷ªº½Σς日İ́  \u0085\x1c\x7f𝔘", "<|endoftext|>", "'s", "it's", "Straße", "tion", "<|"]
    e = WordEncoder(tokenizer_path())
    for _ in range(300):
        texts = ["".join(r.choice(atoms) for _ in range(r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(6)]
        for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
            assert list(ids) == e.tokenizer.encode(t, add_special_tokens=False).ids
