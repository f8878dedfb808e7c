import collections
import random
import re

import numpy as np

from revlens.llm.quality_rules import COMMON, distance, judge_quality, keep_quality

SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = SPACE.findall(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def prose(r, lang, n):
    common = COMMON[lang].split()
    word = lambda: r.choice(common) if r.random() < 0.4 else "".join(r.choice("aeinrstlodé") for _ in range(r.randint(3, 9)))
    return " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize()


def test_counts_against_brute_force_and_verdicts(spark):
    r = random.Random(9)
    rows = [(i, prose(r, lang, r.randint(60, 300)), lang) for i, lang in enumerate(r.choices(list(COMMON), k=200))]
    odd = ["", None, " \n\n ", "a b c " * 40, "x\nx\n\n\nx y\nx y", "é日本 # <b> |" * 30, "  nbsp   em", "same line\n" * 30]
    junk = [prose(r, "en", 200).upper(), " | ".join(prose(r, "en", 1) for _ in range(300)), " ".join(w + "$$$" for w in prose(r, "de", 200).split())]
    rows += [(1000 + i, t, "en" if i % 2 else None) for i, t in enumerate(odd)] + [(2000 + i, t, "en") for i, t in enumerate(junk)] + [(None, rows[0][1], "xx")]
    df = spark.createDataFrame([(d, t, lang, 1) for d, t, lang in rows], "doc_id long, text string, lang string, n_words int")
    got = {r["doc_id"]: r for r in judge_quality(df).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        x = got[d]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute(t), t
        assert x["kept"] == (not x["base_failed"]) or d >= 1000
    assert not any(got[2000 + i]["kept"] for i in range(len(junk)))
    kept = keep_quality(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in got.items() if x["kept"]}
    assert judge_quality(df.limit(0)).collect() == []


def test_no_reference_leaves_the_base_rule(spark):
    df = spark.createDataFrame([(1, " ".join(str(i) for i in range(80)), None)], "doc_id long, text string, lang string")
    assert [r["kept"] for r in judge_quality(df).collect()] == [True]


def test_distance_bounds():
    assert np.allclose(distance(np.array([[0.5, 0.5], [1.0, 0.0]]), np.array([0.5, 0.5]))[0], 0)
    assert np.allclose(distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0])), 1)


def test_other_languages_have_their_own_reference(spark):
    r = random.Random(5)
    rows = [(i, prose(r, lang, 200), lang) for i, lang in enumerate(r.choices(list(COMMON), k=40))]
    script = lambda low: " ".join("".join(chr(low + r.randrange(25)) for _ in range(r.randint(2, 9))) for _ in range(200))
    rows += [(100 + i, script(0x430), "ru") for i in range(30)] + [(200, script(0x3B1), "el"), (201, script(0x430), None)]
    junk = [(300, " | ".join(prose(r, "en", 1) for _ in range(300)), "ru"), (301, script(0x430), "en")]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    kept = {x["doc_id"]: x["kept"] for x in judge_quality(df).collect()}
    assert {d for d, ok in kept.items() if not ok} == {300, 301}
