"""Block-move differences of two word lists, their distance, and the tracking of words through a page's history.

The helpers work on one pair of texts, or on one page's next revision; Spark
deals out pairs (``edit_lists``) and pages (``operators.tracking``).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_words

# Places of one word pair beyond which it seeds nothing, words of a copy and of a kept deletion, and the discount of a replacement.
MOST_PLACES, LEAST_COPY, LEAST_DEAD, REPLACED = 50, 3, 3, 0.4

Edit = tuple[str, int | None, int | None, int]  # kind, left place, right place, words
EDITS = "array<struct<kind:string,i:int,j:int,l:int>>"


def _runs_of_words(left: list, right: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of ``least`` words that begin at each place of both texts: equal runs have equal ones."""
    both = left + right
    names = {w: k for k, w in enumerate(dict.fromkeys(both))}
    words = np.fromiter(map(names.__getitem__, both), np.int64, len(both))
    runs, most = words, len(names)
    for k in range(1, least):
        if most * len(names) >= 1 << 62:
            runs = np.unique(runs, return_inverse=True)[1]
            most = len(both)
        runs, most = runs[: len(both) - k] * len(names) + words[k:], most * len(names)
    return runs[: len(left) - least + 1], runs[len(left) :]


def common_runs(left: list, right: list, least: int) -> list[tuple[int, int, int]]:
    """(i, j, words) of the runs of ``least`` words or more that both texts have, each as long as it goes.

    A run begins at words that the right text does not have too often.
    """
    if min(len(left), len(right)) < least:
        return []
    here, there = _runs_of_words(left, right, least)
    order = np.argsort(there, kind="stable")
    there = there[order]
    first = np.searchsorted(there, here)
    times = np.searchsorted(there, here, "right") - first
    seeds = np.flatnonzero((times > 0) & (times <= MOST_PLACES))
    if not len(seeds):
        return []
    many = times[seeds]
    i = np.repeat(seeds, many)
    shift = order[np.repeat(first[seeds] - np.cumsum(many) + many, many) + np.arange(len(i))] - i
    by_shift = np.argsort(shift, kind="stable")
    i, shift = i[by_shift], shift[by_shift]
    breaks = np.flatnonzero((np.diff(shift) != 0) | (np.diff(i) != 1))
    starts, stops = i[np.concatenate(([0], breaks + 1))], i[np.concatenate((breaks, [len(i) - 1]))] + least
    shifts = shift[np.concatenate(([0], breaks + 1))]
    if times.max() <= MOST_PLACES:
        return list(zip(starts.tolist(), (starts + shifts).tolist(), (stops - starts).tolist(), strict=True))
    # what stands too often begins no run, but runs go on over it
    out, last, reached = [], None, -1
    for start, stop, by in zip(starts.tolist(), stops.tolist(), shifts.tolist(), strict=True):
        if by != last:
            last, reached = by, -1
        if start < reached:
            continue
        while stop < len(left) and stop + by < len(right) and left[stop] == right[stop + by]:
            stop += 1
        out.append((start, start + by, stop - start))
        reached = stop - least + 1
    return out


def _free_parts(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values."""
    flags, out, start = free.tobytes(), [], 0
    while (start := flags.find(1, start)) >= 0:
        stop = flags.find(0, start)
        stop = stop if stop >= 0 else len(flags)
        if stop - start >= least:
            out.append((start, stop - start))
        start = stop
    return out


def _off(i: int, n: int, j: int, m: int, l: int) -> float:
    """How far apart the middles of a run stand in the two texts."""
    return abs((i + l / 2) / n - (j + l / 2) / m)


def _matched(left: list, right: list) -> list[tuple[int, int, int]]:
    n, m = len(left), len(right)
    if min(n, m) <= 2:
        # a text of one or two words: together if they stand together in the other, else where each first occurs
        short, long = (left, right) if n <= m else (right, left)
        together = [k for k in range(len(long) - 1) if len(short) == 2 and long[k : k + 2] == short]
        found = [(0, together[0], 2)] if together else []
        if not found:
            taken: set[int] = set()
            for k, w in enumerate(short):
                at = next((x for x, v in enumerate(long) if v == w and x not in taken), None)
                if at is not None:
                    taken.add(at)
                    found.append((k, at, 1))
        return found if n <= m else [(j, i, l) for i, j, l in found]
    heap = [(-l, _off(i, n, j, m, l), i, j) for i, j, l in common_runs(left, right, 2)]
    heapq.heapify(heap)
    free_left, free_right, out = np.ones(n, bool), np.ones(m, bool), []
    while heap:
        size, _, i, j = heapq.heappop(heap)
        l = -size
        free = free_left[i : i + l] & free_right[j : j + l]
        if free.all():
            free_left[i : i + l] = free_right[j : j + l] = False
            out.append((i, j, l))
        else:
            for at, rest in _free_parts(free, 2):
                heapq.heappush(heap, (-rest, _off(i + at, n, j + at, m, rest), i + at, j + at))
    return out


def _common_ends(left: list, right: list) -> tuple[int, int]:
    most, front = min(len(left), len(right)), 0
    while front < most and left[front] == right[front]:
        front += 1
    rear = 0
    while rear < most - front and left[-1 - rear] == right[-1 - rear]:
        rear += 1
    return front, rear


def _inner(words: list, front: int, rear: int) -> list:
    return words[front : len(words) - rear]


def edit_list(left: list, right: list) -> list[Edit]:
    """What makes the right text of the left one: moves of blocks, the longest first, and what is deleted and inserted."""
    front, rear = _common_ends(left, right)
    a, b = _inner(left, front, rear), _inner(right, front, rear)
    moves = _matched(a, b) if a and b else []
    out: list[Edit] = [("mov", 0, 0, front)] if front else []
    if rear:
        out.append(("mov", len(left) - rear, len(right) - rear, rear))
    out += [("mov", i + front, j + front, l) for i, j, l in moves]
    for kind, side, words in (("del", 0, a), ("ins", 1, b)):
        free = np.ones(len(words), bool)
        for move in moves:
            free[move[side] : move[side] + move[2]] = False
        out += [(kind, at + front, None, l) if kind == "del" else (kind, None, at + front, l) for at, l in _free_parts(free, 1)]
    return out


def _insdel_cost(edits: list[Edit]) -> float:
    """Deletions and insertions that touch cost together the greater side less a share of the smaller.

    Each spans two points between words.  Those that share a point touch, and
    so do those at the two points of a tie: the fronts of the texts, the fronts or the rears of a move that lie before the texts' ends,
    and the text's rears.  Spans are the nodes of a graph whose connected parts cost.

    Fixed rule: a move counts for the ends of the texts with its sides changed over.
    """
    left = max([i + l for kind, i, _, l in edits if kind == "del"] + [j + l for kind, _, j, l in edits if kind == "mov"], default=0)
    right = max([j + l for kind, _, j, l in edits if kind == "ins"] + [i + l for kind, i, _, l in edits if kind == "mov"], default=0)
    spans = [(int(kind == "ins"), i if kind == "del" else j, l) for kind, i, j, l in edits if kind != "mov"]
    at: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, (side, front, l) in enumerate(spans):
        at[side, front].append(k)
        at[side, front + l].append(k)
    moves = [(i, j, l) for kind, i, j, l in edits if kind == "mov"]
    ties = [((0, 0), (1, 0))]
    ties += [((0, i), (1, j)) for i, j, _ in moves if i < left] + [((0, i + l), (1, j + l)) for i, j, l in moves if j + l < right]
    ties += [((0, front + l), (1, right)) for side, front, l in spans if side == 0 and front + l >= left]
    near: dict[int, set[int]] = {k: set() for k in range(len(spans))}
    for group in [*at.values(), *[at.get(a, []) + at.get(b, []) for a, b in ties]]:
        for k, other in zip(group, group[1:], strict=False):
            near[k].add(other)
            near[other].add(k)
    cost, seen = 0.0, set()
    for k in near:
        reached, sums = [k] if k not in seen else [], [0, 0]
        seen.update(reached)
        while reached:
            here = reached.pop()
            sums[spans[here][0]] += spans[here][2]
            more = near[here] - seen
            seen |= more
            reached += more
        cost += max(sums) - REPLACED * min(sums)
    return cost


def _move_cost(edits: list[Edit], length: int) -> float:
    """Words of every two moves that change places, multiplied, over the length."""
    moves = sorted((i, j, l) for kind, i, j, l in edits if kind == "mov")
    j, l = np.array([m[1] for m in moves]), np.array([m[2] for m in moves], float)
    return sum(float(l[k] * l[k + 1 :][j[k + 1 :] < j[k]].sum()) for k in range(len(moves))) / max(length, 1)


def edit_distance(edits: list[Edit], length: int) -> float:
    return _insdel_cost(edits) + _move_cost(edits, length)


# --- composition ------------------------------------------------------------------


def _places(edits: list[Edit], kept: int, other: int, n: int) -> np.ndarray:
    """For each word of one side the place that the edits give it on the other, or -1."""
    out = np.full(n, -1)
    for edit in edits:
        if edit[0] == "mov":
            out[edit[kept] : edit[kept] + edit[3]] = np.arange(edit[other], edit[other] + edit[3])
    return out


def _runs(*columns: np.ndarray) -> list[tuple[int, ...]]:
    """(start in each column ..., length) of the stretches over which all columns rise by one."""
    if not len(columns[0]):
        return []
    breaks = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 1 for c in columns])) + 1
    first, stops = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(columns[0])]))
    return [(*[int(c[a]) for c in columns], int(b - a)) for a, b in zip(first, stops, strict=True)]


def composed(first: list[Edit], second: list[Edit], n_middle: int) -> list[Edit]:
    """What two edit lists say together, by way of each word of the text between: moves, and what goes or comes on one of the ways."""
    left, right = _places(first, 2, 1, n_middle), _places(second, 1, 2, n_middle)
    both = (left >= 0) & (right >= 0)
    out: list[Edit] = [("mov", i, j, l) for i, j, l in _runs(left[both], right[both])]
    out += [("del", i, None, l) for i, l in _runs(left[(left >= 0) & (right < 0)])]
    return out + [("ins", None, j, l) for j, l in _runs(right[(left < 0) & (right >= 0)])]


def open_words(edits: list[Edit], n: int, side: int) -> np.ndarray:
    """The places of one side (1: left, 2: right) that a list leaves open."""
    free = np.ones(n, bool)
    for edit in edits:
        if edit[side] is not None:
            free[edit[side] : edit[side] + edit[3]] = False
    return np.flatnonzero(free)


def _joined(words: list, places: np.ndarray, mark: object) -> tuple[list, np.ndarray]:
    """The open stretches of a text with a separator between each two, and the place of every word (a separator's is -1)."""
    out, at = [], []
    for start, l in _runs(places):
        if out:
            out.append(mark)
            at.append(-1)
        out += words[start : start + l]
        at += range(start, start + l)
    return out, np.array(at, np.int64)


def completed(left: list, right: list, edits: list[Edit]) -> list[Edit]:
    """``edits``, and the differences of what they leave open on both sides.

    Open stretches are joined by separators, of which each side has its own, so that no run of words goes across two of them.
    """
    (a, at_a), (b, at_b) = (_joined(words, open_words(edits, len(words), side), mark) for words, side, mark in ((left, 1, _LEFT), (right, 2, _RIGHT)))
    out = list(edits)
    for kind, i, j, l in edit_list(a, b):
        if kind == "mov":
            out.append(("mov", int(at_a[i]), int(at_b[j]), l))
        else:
            places = at_a[i : i + l] if kind == "del" else at_b[j : j + l]
            out += [(kind, start, None, n) if kind == "del" else (kind, None, start, n) for start, n in _runs(places[places >= 0])]
    return out


#: Separators: of no text, and unlike each other.
_LEFT, _RIGHT = ("left",), ("right",)


@dataclass(frozen=True)
class Shortcut:
    # A composition serves if its better covered side leaves at most such a share and so many words open.
    share: float = 0.20
    words: int = 100


def _by_way(older: list, newer: list, ways: list[tuple[list[Edit], list[Edit], int]], rule: Shortcut) -> list[Edit] | None:
    """The edits from ``older`` to ``newer`` by way of the text that leaves least open (the first of equals); None where none serves."""
    best = None
    for first, second, n_middle in ways:
        edits = composed(first, second, n_middle)
        left = [(len(open_words(edits, len(words), side)), len(words)) for words, side in ((older, 1), (newer, 2))]
        unseen = min(o for o, _ in left)
        if min((o + 1) / (n + 1) for o, n in left) <= rule.share and unseen <= rule.words and (best is None or unseen < best[0]):
            best = (unseen, edits)
    return completed(older, newer, best[1]) if best else None


def _compared(batches: Iterator[pd.DataFrame], horizon: int, rule: Shortcut | None, lists: bool) -> Iterator[pd.DataFrame]:
    name, recent = None, []  # (revision, words, edits from each recent revision to this one), the last first
    known: dict[tuple, list[Edit]] = {}
    for pdf in batches:
        out = []
        for page, revision, words in zip(pdf["page"], pdf["revision"], pdf["words"], strict=True):
            if page != name:
                name, recent, known = page, [], {}
            words = list(words) if words is not None else []
            for k, (older, text) in enumerate(recent):
                ways = [(known[older, m], known[m, revision], len(t)) for m, t in recent[:k]] if rule is not None else []
                edits = _by_way(text, words, ways, rule) if ways else None
                edits = known[older, revision] = edit_list(text, words) if edits is None else edits
                row = (page, older, revision, edit_distance(edits, max(len(text), len(words))))
                out.append((*row, [{"kind": e, "i": i, "j": j, "l": l} for e, i, j, l in edits]) if lists else row)
            recent.insert(0, (revision, words))
            if len(recent) > horizon:
                gone = recent.pop()[0]
                known = {pair: edits for pair, edits in known.items() if pair[0] != gone} if rule is not None else {}
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=_PAIR + ["edits"] * lists)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_PAIR + ["edits"] * lists)


_PAIR = ["page", "a", "b", "distance"]


def page_distances(revs: DataFrame, order: list[str], horizon: int, shortcut: Shortcut | None = None, lists: bool = False) -> DataFrame:
    """(page, a, b, distance, and ``edits`` with ``lists``) of each revision and each of the ``horizon`` before it.

    A page's revisions pass in order through one task that holds the last texts, so each text is sent once.  With
    ``shortcut`` edits to older texts are composed of known ones where these cover enough, and only the rest is compared.
    """
    rows = revs.select("page", F.col("revision").cast("long").alias("revision"), "words", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.repartition("page").sortWithinPartitions("page", *keys).drop(*keys)
    schema = f"page {dict(rows.dtypes)['page']}, a long, b long, distance double" + f", edits {EDITS}" * lists
    return dealt.mapInPandas(lambda it: _compared(it, horizon, shortcut, lists), schema)


# --- tracking ---------------------------------------------------------------------

Move = tuple[str, int, int, int, int, int]  # kind, left place, left chunk, right place, right chunk, words


def tracked(chunks: list[list], words: list, trim: bool = True) -> tuple[list[list], list[Move]]:
    """The next revision's chunks (the live text, then deleted blocks), and where their words come from.

    A run of a live or deleted chunk may come back more than once.  Of the
    live text and of old blocks, what comes back nowhere stays as a deleted block if it is long
    enough.  Kinds: mov, ins (no left place), del (what is too short to stay).
    With ``trim`` common ends of the live texts are kept first, however short.
    """
    front, rear = _common_ends(chunks[0], words) if trim else (0, 0)
    live, inner = _inner(chunks[0], front, rear), _inner(words, front, rear)
    sources = [live, *chunks[1:]]
    n, m = max(len(live), 1), max(len(inner), 1)
    heap = [(-l, -c, _off(i, max(len(source), 1), j, m, l), i, j) for c, source in enumerate(sources) for i, j, l in common_runs(source, inner, LEAST_COPY)]
    heapq.heapify(heap)
    free, used, moves = np.ones(len(inner), bool), [np.zeros(len(s), bool) for s in sources], []
    while heap:
        size, chunk, _, i, j = heapq.heappop(heap)
        l, c = -size, -chunk
        parts = _free_parts(free[j : j + l], LEAST_COPY)
        if parts == [(0, l)]:
            free[j : j + l], used[c][i : i + l] = False, True
            moves.append(("mov", i, c, j, 0, l))
        else:
            for at, rest in parts:
                heapq.heappush(heap, (-rest, chunk, _off(i + at, max(len(sources[c]), 1), j + at, m, rest), i + at, j + at))
    moves += [("ins", -1, -1, j, 0, l) for j, l in _free_parts(free, 1)]
    # places within the whole live text
    moves = [(kind, i + front if c == 0 else i, c, j + front, d, l) for kind, i, c, j, d, l in moves]
    moves += [("mov", 0, 0, 0, 0, front)] if front else []
    moves += [("mov", len(chunks[0]) - rear, 0, len(words) - rear, 0, rear)] if rear else []
    out = [list(words)]
    for c, source in enumerate(sources):
        for i, l in _free_parts(~used[c], 1):
            shift = front if c == 0 else 0
            if l >= LEAST_DEAD:
                moves.append(("mov", i + shift, c, 0, len(out), l))
                out.append(source[i : i + l])
            else:
                moves.append(("del", i + shift, c, -1, -1, l))
    return out, moves


# --- Spark ------------------------------------------------------------------------


def _edits_of(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "i": i, "j": j, "l": l} for k, i, j, l in edit_list(list(a), list(b))] for a, b in zip(left, right, strict=True)])


def _distance_of(edits: pd.Series, length: pd.Series) -> pd.Series:
    place = lambda x: None if pd.isna(x) else int(x)
    return pd.Series([edit_distance([(e["kind"], place(e["i"]), place(e["j"]), int(e["l"])) for e in es], int(n)) for es, n in zip(edits, length, strict=True)])


def edit_lists(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with the edit list of two word arrays as ``edits`` and their ``distance``; crossing moves count by the longer text."""
    listed = pairs.withColumn("edits", F.pandas_udf(_edits_of, EDITS)(left, right))
    return listed.withColumn("distance", F.pandas_udf(_distance_of, "double")("edits", F.greatest(F.size(left), F.size(right))))


def pairs_in_horizon(revs: DataFrame, page: str, order: list[str], words: str, horizon: int) -> DataFrame:
    """Each revision with the ones up to ``horizon`` before it on its page: (page, left, right numbers and words)."""
    numbered = revs.select(page, F.row_number().over(Window.partitionBy(page).orderBy(*order)).alias("n"), F.col(words).alias("w"))
    near = numbered.select(page, F.explode(F.sequence(F.col("n") + 1, F.col("n") + horizon)).alias("right"), F.col("n").alias("left"), F.col("w").alias("left_words"))
    later = numbered.select(page, F.col("n").alias("right"), F.col("w").alias("right_words"))
    return near.join(later, [page, "right"])


def reverted(distances: DataFrame) -> DataFrame:
    """Of (page, right, left, distance) the closest earlier revision of each, the later of equals, and whether it beats the previous one."""
    best = distances.groupBy("page", "right").agg(F.min(F.struct("distance", (-F.col("left")).alias("o"))).alias("m"), F.max(F.struct("left", "distance")).alias("p"))
    return best.select("page", "right", (-F.col("m.o")).alias("closest"), F.col("m.distance").alias("distance"), (F.col("m.distance") < F.col("p.distance")).alias("is_revert"))


def words_of(text: Column) -> Column:
    return canonical_words(text)
