import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from revlens.operators import tracking
from revlens.operators.diff import edit_distance, edit_list

TEXTS = ["one two three four five six", "one two three new word four five six", "six five four", "one two three four five six"]


def told(spark, rule=tracking.Trust()):
    rows = [("p", n + 1, n % 2 + 1, n * 86400, 2.0, t) for n, t in enumerate(TEXTS)] + [("q", 9, None, 0, None, None)]
    revs = spark.createDataFrame(rows, "page string, revision long, author long, s long, weight double, text string")
    revs = revs.select("page", "revision", "author", F.timestamp_seconds("s").alias("ts"), "weight", F.split("text", " ").alias("words"))
    return tracking.track_words(revs, ["revision"], rule)


def test_origins_and_counts(spark):
    rows = {r["revision"]: r for r in told(spark).collect()}
    assert rows[1]["origin"] == [1] * 6 and rows[1]["n_new"] == 6
    assert rows[2]["origin"] == [1, 1, 1, 2, 2, 1, 1, 1] and rows[2]["writer"] == [1, 1, 1, 2, 2, 1, 1, 1]
    # the third has no run of three words of the second, only its last word in the same place of neither
    assert rows[3]["n_back"] == 0
    # deleted blocks come back with their origin
    assert rows[4]["n_back"] > 0 and rows[4]["origin"][:3] == [1, 1, 1]
    assert rows[9]["words"] == [] and rows[9]["n_new"] == 0 and rows[9]["author"] == 0


def test_trust_of_new_and_kept_words(spark):
    rule = tracking.Trust()
    rows = {r["revision"]: r for r in told(spark, rule).collect()}
    new = 2.0 * rule.lends
    assert all(math.isclose(t, new) for t in rows[1]["trust"])
    # the first word stands far from the cut, at the start of both texts: only reading raises it
    cut = new + (new - new) * 1
    assert math.isclose(rows[2]["trust"][0], cut + (2.0 - cut) * rule.reads)


def test_words_and_days_by_author(spark):
    t = told(spark)
    assert tracking.words_by_author(t).first()["author"] == 1
    days = {r["author"]: r["word_days"] for r in tracking.contribution(t, ["revision"], F.timestamp_seconds(F.lit(5 * 86400))).collect()}
    shown = [(1, r["writer"], 1 if r["revision"] < 4 else 2) for r in t.where("page = 'p'").collect()]
    for author in (1, 2):
        assert math.isclose(days[author], sum(w.count(author) * d for _, w, d in shown))


def test_percolation(spark):
    older = spark.createDataFrame([(1, 0, 0.5), (1, 1, 3.0), (1, 2, 1.0)], "pair int, at int, trust double")
    newer = spark.createDataFrame([(1, 0, 9.0), (1, 4, 2.0), (1, 5, 1.0)], "pair int, at int, trust double")
    moves = spark.createDataFrame([(1, "mov", 0, 4, 2), (1, "del", 2, None, 1)], "pair int, kind string, i int, j int, l int")
    got = {r["at"]: r["trust"] for r in tracking.percolated(older, newer, moves).collect()}
    assert got == {0: 2.0, 1: 3.0, 2: 1.0}


def signed(spark, rows, **rule):
    revs = spark.createDataFrame([("p", n, a, n * 100, w, t, v) for n, (a, w, t, v) in enumerate(rows)], "page string, revision long, author long, s long, weight double, text string, vote boolean")
    revs = revs.select("page", "revision", "author", F.timestamp_seconds("s").alias("ts"), "weight", F.split("text", " ").alias("words"), "vote")
    return [r for r in tracking.track_words(revs, ["revision"], tracking.Trust(kind="signed", **rule)).orderBy("revision").collect()]


def test_an_author_raises_a_word_once(spark):
    text = "some words that stay"
    rows = signed(spark, [(1, 3.0, text, False), (2, 3.0, text, False), (2, 3.0, text, False), (0, 3.0, text, False), (3, 3.0, None, True)])
    first, second, again, anonymous, vote = (r["trust"] for r in rows)
    new = 3.0 * 0.3
    # the first revision's words are new: raised by looking and by reading
    assert all(new < t < 3.0 for t in first)
    # nothing is looked at by one who changes nothing, yet looking counts one step away; another author raises, the same one does not
    looked = [t + (3.0 - t) * 0.18 * 0.5 ** (1 / 10) for t in first]
    assert all(math.isclose(b, x + (3.0 - x) * 0.10) for b, x in zip(second, looked))
    assert again == second and anonymous == second
    # a vote reads all, but looks at nothing; its words are the page's
    assert all(math.isclose(v, t + (3.0 - t) * 0.10) for v, t in zip(vote, second)) and rows[4]["words"] == text.split()
    numbers = [{(s >> 10 * i) & 1023 for i in range(3)} for s in rows[4]["signature"]]
    assert all({tracking.author_number(a, w) for a in (1, 2, 3)} == n for n, w in zip(numbers, text.split()))


def test_trust_falls_at_cuts_for_every_author(spark):
    rows = signed(spark, [(1, 9.0, "a b c d e f g h", False), (0, 0.0, "a b c d x e f g h", False)])
    before, after = rows[0]["trust"], rows[1]["trust"]
    kept = after[:4] + after[5:]
    assert after[4] == 0 and all(x <= y for x, y in zip(kept, before)) and kept[3] == 0 and kept[4] == 0
    # the farther from the cut, the less
    assert kept[0] > kept[1] > kept[2] > kept[3] and math.isclose(kept[2], before[2] * (1 - math.exp(-1 / 2)))


def page_of_reverts(n, seed):
    """Revisions of one page: small edits, copies of earlier texts, cuts and votes."""
    r = random.Random(seed)
    texts, rows = [["w%d" % r.randint(0, 60) for _ in range(30)]], []
    for k in range(n):
        words = list(texts[-1])
        act = r.random()
        if act < 0.25 and len(texts) > 2:
            words = list(texts[-r.randint(2, min(5, len(texts)))])
        elif act < 0.4 and len(words) > 12:
            a = r.randint(0, len(words) - 8)
            del words[a : a + 7]
        else:
            words[r.randint(0, len(words)) : 0] = ["w%d" % r.randint(0, 60) for _ in range(r.randint(1, 6))]
        vote = r.random() < 0.1 and k > 0
        rows.append(("p", k, r.randint(0, 4), k * 3600, r.choice([0.5, 2.0, 5.0]), None if vote else " ".join(words), vote, r.random() < 0.2))
        if not vote:
            texts.append(words)
    return rows


def frame_of(spark, rows):
    revs = spark.createDataFrame(rows, "page string, revision long, author long, s long, weight double, text string, vote boolean, robot boolean")
    return revs.select("page", "revision", "author", F.timestamp_seconds("s").alias("ts"), "weight", F.split("text", " ").alias("words"), "vote", "robot")


def test_a_text_taken_back_has_the_words_of_the_one_it_repeats(spark):
    one = "a b c d e f g h i j k l".split()
    two = "x1 x2 x3 x4 x5 x6".split()
    rows = [("p", 0, 1, 0, 5.0, " ".join(one), False, False), ("p", 1, 2, 10, 0.1, " ".join(one[:2] + two), False, False), ("p", 2, 3, 20, 1.0, " ".join(one), False, False)]
    plain, aware = (tracking.track_words(frame_of(spark, rows), ["revision"], tracking.Trust(kind="signed", recents=k)).orderBy("revision").collect() for k in (1, 4))
    assert aware[2]["origin"] == [0] * 12 and aware[2]["writer"] == [1] * 12
    # every word is trusted at least as the plain comparison has it, and keeps the signature of the greater
    assert all(a >= b for a, b in zip(aware[2]["trust"], plain[2]["trust"])) and aware[2]["trust"] != plain[2]["trust"]
    assert [r["trust"] for r in aware[:2]] == [r["trust"] for r in plain[:2]]


def looped(rows, rule):
    """The fold over one page again, from its definition: whole lists of all texts, one row after the other."""
    history, dead, out, count = [], [], [], 0
    for _, k, author, s, weight, text, vote, robot in rows:
        words = history[-1]["block"].words if vote else text.split()
        edit = tracking.Edit(k, author, weight, s * 10**6, rule.reads, 0.0 if vote else rule.looks)
        section = np.zeros(len(words), np.int64)
        live = history[-1]["block"] if history else tracking._empty()
        if vote:
            new = tracking._followed([live], words, section, edit, (count, s), rule)[0]
            history[-1]["block"] = new
            out.append((k, list(new.trust), list(new.origin), list(new.signature)))
            continue
        new, gone, _, _ = tracking._followed([live, *dead], words, section, edit, (count, s), rule)
        near = history[::-1][: rule.recents]
        d = [edit_distance(edit_list(h["block"].words, words), max(len(words), len(h["block"].words))) for h in near]
        best = min(range(len(d)), key=lambda i: (d[i], i), default=0)
        if d and d[best] < d[0]:
            other = tracking._followed([near[best]["block"], live, *dead], words, section, edit, (count, s), rule)[0]
            new.origin, new.writer = other.origin, other.writer
            for i in range(len(words)):
                if other.trust[i] > new.trust[i]:
                    new.trust[i], new.signature[i] = other.trust[i], other.signature[i]
        dead = tracking._young(gone, (count, s), rule)
        if rule.percolates and not robot:
            for h in near:
                for kind, i, j, l in edit_list(h["block"].words, words):
                    for x in range(l if kind == "mov" else 0):
                        h["block"].trust[i + x] = max(h["block"].trust[i + x], new.trust[j + x])
        count += 1
        history.append({"k": k, "block": new})
        if not rule.percolates:
            out.append((k, list(new.trust), list(new.origin), list(new.signature)))
    if rule.percolates:
        out += [(h["k"], list(h["block"].trust), list(h["block"].origin), list(h["block"].signature)) for h in history]
    return sorted(out)


@pytest.mark.parametrize("rule", [tracking.Trust(kind="signed", recents=5), tracking.Trust(kind="signed", recents=5, percolates=True), tracking.Trust.batch(kind="sections", recents=3), tracking.Trust(recents=4, percolates=True)])
def test_reverts_votes_and_percolation_equal_a_plain_loop(spark, rule):
    rows = page_of_reverts(40, 7)
    got = tracking.track_words(frame_of(spark, rows), ["revision"], rule).collect()
    assert sorted((r["revision"], r["trust"], r["origin"], r["signature"]) for r in got) == looped(rows, rule)


def test_a_long_page_goes_out_in_bounded_frames(spark):
    rows = [("p", k, 1, k, 1.0, " ".join(f"w{(k + i) % 500}" for i in range(300)), False, False) for k in range(1000)]
    frames = list(tracking._fold(iter([frame_of(spark, rows).withColumn("sections", F.lit(None)).withColumn("reads", F.lit(0.1)).withColumn("looks", F.lit(0.1)).withColumn("text", F.lit(None).cast("string")).orderBy("revision").toPandas()]), tracking.Trust()))
    assert sum(map(len, frames)) == 1000 and max(map(len, frames)) <= tracking.FRAME_WORDS // 300 + 1


def test_who_comes_soon_reads_less(spark):
    rows = [("p", k, 1, s, 1.0, "a b", False, k == 3) for k, s in enumerate((0, 60, 60 + 86_400, 10**9, 10**9 + 5))]
    for on_line in (True, False):
        told = {r["revision"]: r for r in tracking.timed_reads(frame_of(spark, rows), ["ts"], on_line=on_line).collect()}
        full, f = tracking.Trust().reads, [1 - math.exp(-60 / 86400), 1 - math.exp(-1)]
        want = [1 - (1 - full) ** x if on_line else full * x for x in f]
        assert told[0]["reads"] == full and told[3]["reads"] == told[3]["looks"] == 0
        assert all(math.isclose(told[k + 1]["reads"], want[k]) for k in range(2)) and "_passed" not in told[0]
