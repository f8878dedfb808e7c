import math
import random

from pyspark.sql import functions as F

from revlens.operators.diff import edit_distance, edit_list, edit_lists, tracked, words_of
from revlens.functions import markup
from revlens.operators import diff


def rebuilt(left, right, edits):
    """The right text, put together from the left one and the edits."""
    out = [None] * len(right)
    for kind, i, j, l in edits:
        if kind == "mov":
            out[j : j + l] = left[i : i + l]
        elif kind == "ins":
            out[j : j + l] = right[j : j + l]
    return out


def test_edits_rebuild_the_text_and_cover_each_word_once():
    r = random.Random(1)
    for _ in range(300):
        words = "abcdefgh"[: r.randint(2, 8)]
        left, right = ([r.choice(words) for _ in range(r.randint(0, 25))] for _ in range(2))
        edits = edit_list(left, right)
        assert rebuilt(left, right, edits) == right
        assert sum(l for k, _, _, l in edits if k != "ins") == len(left) and sum(l for k, _, _, l in edits if k != "del") == len(right)
        shuffled = r.sample(edits, len(edits))
        assert math.isclose(edit_distance(shuffled, 9), edit_distance(edits, 9))


def test_hand_derived_distances():
    old = "the red fox ran over the hill".split()
    # one word more
    assert edit_distance(edit_list(old, "the red fox ran fast over the hill".split()), 7) == 1
    # a replacement: the greater side less 0.4 of the smaller
    assert edit_distance(edit_list(old, "the red fox ran under the hill".split()), 7) == 1 - 0.4
    # two blocks of 3 and 4 words change places: 3 * 4 / 7
    assert edit_list(old, "ran over the hill the red fox".split()) == [("mov", 3, 0, 4), ("mov", 0, 4, 3)]
    assert math.isclose(edit_distance(edit_list(old, "ran over the hill the red fox".split()), 7), 12 / 7)
    assert edit_list([], ["a"]) == [("ins", None, 0, 1)] and edit_list(["a"], []) == [("del", 0, None, 1)] and edit_list([], []) == []


def test_tracked_words_die_and_come_back():
    one = "we keep all of these words here".split()
    two = "we keep here".split()
    chunks, moves = tracked([one], two)
    assert chunks == [two, "all of these words".split()] and ("mov", 2, 0, 0, 1, 4) in moves
    back, moves = tracked(chunks, "we keep all of these words here".split())
    assert back == [one] and ("mov", 0, 1, 2, 0, 4) in moves
    # a block may come back twice; what is too short to stay is deleted
    copied, moves = tracked(["x y z".split(), "p q r".split()], "p q r p q r x".split(), trim=False)
    assert copied[0] == "p q r p q r x".split() and sum(m[0] == "mov" and m[2] == 1 and m[4] == 0 for m in moves) == 2
    assert [c for c in copied[1:]] == ["x y z".split()]


def test_pairs_in_horizon(spark):
    rows = [(1, n, f"alpha beta {'gamma ' * n}") for n in range(4)] + [(2, 7, None)]
    revs = spark.createDataFrame(rows, "page long, revision long, text string").select("page", "revision", words_of("text").alias("words"))
    pairs = diff.pairs_in_horizon(revs, "page", ["revision"], "words", 2)
    got = {(r["left"], r["right"]): r["distance"] for r in edit_lists(pairs, "left_words", "right_words").collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (2, 3): 1, (2, 4): 2, (3, 4): 1}


# Texts and the published distances between each two of them, over the shorter text.
GOLDEN_TEXTS = [
    "Il bene comune coincide col bene individuale.",
    "Il bene comune non coincide col bene individuale.",
    "Nella maggior parte dei casi, il bene comune non coincide con il bene individuale.",
    "In molti casi, il bene comune non coincide completamente con quello individuale, a causa dell'egoismo delle persone.",
    "In molti casi, il bene comune non coincide con quello individuale.  Questo e' causato dall'egoismo delle persone, che cercano di massimizzare il loro bene individuale, invece di quello comune.",
    "In generale, il bene comune non coincide con quello individuale.  La causa e' l'egoismo delle persone, che cercano di massimizzare il loro bene individuale, invece di quello comune.",
    "In generale, il bene comune non coincide con quello individuale, dato che le persone non badano a quello comune.",
    "Volete comperare Viagra? Molto buono dato che le persone non badano a quello comune.",
]
GOLDEN = [[], [1], [8.2, 6.6], [12.4, 10.8, 10.6], [23.2, 21.6, 20.8, 15.8], [22.2, 20.6, 21.8, 17.4, 4], [14.4, 12.8, 14, 9.6, 14.8, 13.2], [11.2, 10.8, 8.4, 11.4, 22.2, 21.2, 8]]


def test_golden_distances(spark):
    texts = spark.createDataFrame(list(enumerate(GOLDEN_TEXTS)), "n int, text string").select("n", markup.words_only(markup.wiki_words("text")).alias("words"))
    words = {r["n"]: r["words"] for r in texts.collect()}
    for right, row in enumerate(GOLDEN):
        for left, distance in enumerate(row):
            assert math.isclose(edit_distance(edit_list(words[left], words[right]), min(len(words[left]), len(words[right]))), distance)


def test_crossing_moves_count_by_the_longer_text(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f", "d e f a b c x")], "pair int, l string, r string").select("pair", F.split("l", " ").alias("l"), F.split("r", " ").alias("r"))
    (row,) = edit_lists(pairs, "l", "r").collect()
    # one word more, and 3 * 3 over the seven words of the longer text
    assert math.isclose(row["distance"], 1 + 9 / 7)


def test_spans_that_touch_cost_together():
    # a deletion before a move and an insertion before the same move; one behind it does not touch them
    assert edit_distance([("del", 0, None, 2), ("ins", None, 0, 3), ("mov", 2, 3, 9), ("ins", None, 12, 4)], 20) == 3 - 0.4 * 2 + 4
    # across the ends of a move, as the published examples have it
    assert math.isclose(edit_distance([("mov", 0, 0, 2), ("mov", 6, 4, 3), ("del", 2, None, 4), ("ins", None, 2, 2)], 20), 3.2)
    assert edit_distance([("del", 0, None, 2), ("mov", 2, 0, 3), ("ins", None, 3, 3)], 20) == 5
    assert edit_distance([], 0) == 0


def test_compositions_complete_the_edits_and_rebuild_the_text():
    r = random.Random(4)
    for _ in range(200):
        one = [r.choice("abcdefghij") for _ in range(r.randint(0, 30))]
        texts = [one]
        for _ in range(2):
            words = list(texts[-1])
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(words))
                if r.random() < 0.5:
                    words[at:at] = [r.choice("abcdefghij") for _ in range(r.randint(1, 5))]
                else:
                    part = words[at : at + 6]
                    del words[at : at + 6]
                    if r.random() < 0.6:
                        to = r.randint(0, len(words))
                        words[to:to] = part
            texts.append(words)
        a, b, c = texts
        zipped = diff.composed(edit_list(a, b), edit_list(b, c), len(b))
        for kind, i, j, l in zipped:
            assert kind != "mov" or a[i : i + l] == c[j : j + l]
        edits = diff.completed(a, c, zipped)
        assert rebuilt(a, c, edits) == c
        for side, words, out in ((1, a, "ins"), (2, c, "del")):
            covered = sorted(x for e in edits if e[0] != out for x in range(e[side], e[side] + e[3]))
            assert covered == list(range(len(words)))


def test_words_that_no_way_keeps_are_compared_again():
    # the middle text lost a block that both ends have
    a, b, c = "p q r s t u v w".split(), "p q v w".split(), "p q r s t u v w x".split()
    zipped = diff.composed(edit_list(a, b), edit_list(b, c), len(b))
    assert sum(l for k, *_, l in zipped if k == "mov") == 4
    edits = diff.completed(a, c, zipped)
    assert ("mov", 2, 2, 4) in edits and sum(l for k, *_, l in edits if k == "ins") == 1 and not [e for e in edits if e[0] == "del"]
    # two open stretches of one side are not taken for one
    left, right = "a b x c d".split(), "a b c d".split()
    assert diff.completed(left, right, [("mov", 2, 0, 0)]) and ("mov", 0, 0, 2) in diff.completed(left, right, [("del", 2, None, 1)])


def test_distances_of_a_page_are_those_of_its_pairs(spark):
    r = random.Random(8)
    rows = []
    for page in (1, 2):
        words = [f"w{r.randint(0, 30)}" for _ in range(25)]
        for n in range(9):
            at = r.randint(0, len(words))
            words = words[:at] + [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 3))] + words[at + r.randint(0, 2) :]
            rows.append((page, page * 100 + n, list(words) if n != 4 else None))
    revs = spark.createDataFrame(rows, "page long, revision long, words array<string>")
    texts = {r: w or [] for _, r, w in rows}
    got = {(x["a"], x["b"]): x["distance"] for x in diff.page_distances(revs, ["revision"], 4).collect()}
    want = {(a, b): edit_distance(edit_list(texts[a], texts[b]), max(len(texts[a]), len(texts[b]))) for a in texts for b in texts if a < b <= a + 4 and a // 100 == b // 100}
    assert got == want
    short = diff.page_distances(revs, ["revision"], 4, diff.Shortcut(), lists=True).collect()
    assert {(x["a"], x["b"]) for x in short} == set(want)
    for x in short:
        edits = [(e["kind"], e["i"], e["j"], e["l"]) for e in x["edits"]]
        assert rebuilt(texts[x["a"]], texts[x["b"]], edits) == texts[x["b"]]
        if x["b"] == x["a"] + 1:
            assert x["distance"] == want[x["a"], x["b"]]
