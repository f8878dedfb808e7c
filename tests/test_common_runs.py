import random

from revlens.operators import diff


def plain_runs(left, right, least):
    """Each run from its first word that the right text does not have too often."""
    grams = [tuple(right[j : j + least]) for j in range(len(right) - least + 1)]
    out, reached = [], {}
    for i in range(len(left) - least + 1):
        at = [j for j, g in enumerate(grams) if g == tuple(left[i : i + least])]
        for j in at if len(at) <= diff.MOST_PLACES else ():
            if i >= reached.get(j - i, -1):
                l = least
                while i + l < len(left) and j + l < len(right) and left[i + l] == right[j + l]:
                    l += 1
                out.append((i, j, l))
                reached[j - i] = i + l - least + 1
    return sorted(out)


def test_common_runs_are_those_of_plain_loops():
    r = random.Random(5)
    for most in (1, 2, 3, 20, 200):
        for _ in range(20):
            left, right = ([f"w{r.randrange(most)}" for _ in range(r.randrange(90))] for _ in range(2))
            for least in (2, 3):
                assert sorted(diff.common_runs(left, right + left[10:40], least)) == plain_runs(left, right + left[10:40], least)


class Word(str):
    looks = 0

    def __hash__(self):
        Word.looks += 1
        return super().__hash__()


def test_each_word_is_looked_up_twice_whatever_the_runs():
    words = [Word(f"w{k % 700}") for k in range(2_000)]
    assert diff.common_runs(words, words[1_000:] + words[:1_000], 3)
    assert Word.looks <= 2 * 2 * len(words) + 700  # before: every run of words hashed all of its words, 14,094 looks
