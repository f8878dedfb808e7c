"""Edit lists as tables.

An edit list of a pair of texts has rows (pair, kind, i, j, l): "mov" carries
l words from i in the left text to j in the right one, "del" l words from i
(j is null), "ins" l words at j (i is null).  Lists are joined on ``pair``
and on overlapping ranges of positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slices import by_slices


def rendered(edits: DataFrame) -> DataFrame:
    """One line per list: ``Ins(j, l)``, ``Del(i, l)``, ``Mov(i, j, l)``, in the order of left, then right positions."""
    one = (
        F.when(F.col("kind") == "mov", F.format_string("Mov(%d, %d, %d)", "i", "j", "l"))
        .when(F.col("kind") == "del", F.format_string("Del(%d, %d)", "i", "l"))
        .otherwise(F.format_string("Ins(%d, %d)", "j", "l"))
    )
    place = F.struct(F.coalesce("i", F.lit(1 << 40)).alias("i"), F.coalesce("j", F.lit(-1)).alias("j"), one.alias("text"))
    return edits.groupBy("pair").agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda e: e["text"]), " ").alias("edits"))


def side(edits: DataFrame, left: bool) -> DataFrame:
    """The edits that take words of one side, with their place there as ``at``."""
    own = "i" if left else "j"
    return edits.where(F.col(own).isNotNull()).withColumn("at", F.col(own))


def cover(edits: DataFrame) -> DataFrame:
    """How many words of each side a list accounts for."""
    words = lambda own: F.coalesce(F.sum(F.when(F.col(own).isNotNull(), F.col("l"))), F.lit(0))
    return edits.groupBy("pair").agg(words("i").alias("left_words"), words("j").alias("right_words"))


def complement(edits: DataFrame, lengths: DataFrame, left: bool) -> DataFrame:
    """(pair, start, length) of the runs of one side that no edit accounts for; ``lengths`` has pair and n."""
    taken = side(edits, left).select("pair", F.col("at").alias("start"), (F.col("at") + F.col("l")).alias("stop"))
    ends = lengths.select("pair", F.col("n").alias("start"), F.col("n").alias("stop"))
    before = F.max("stop").over(Window.partitionBy("pair").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    gaps = taken.unionByName(ends).select("pair", F.coalesce(before, F.lit(0)).alias("from"), F.col("start").alias("to"))
    return gaps.where(F.col("to") > F.col("from")).select("pair", F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("length"))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The edits from a first text to a third, by way of a second.

    Ranges of the middle text meet where they overlap: a move then a move is
    a move, a move then a deletion a deletion, an insertion then a move an insertion; what is
    inserted and deleted again leaves nothing.
    """
    a = side(first, left=False).select("pair", "i", "at", "l")
    b = side(second, left=True).select("pair", F.col("j").alias("j2"), F.col("at").alias("at2"), F.col("l").alias("l2"))
    # the range join
    met = a.join(b, "pair").where((F.col("at") < F.col("at2") + F.col("l2")) & (F.col("at2") < F.col("at") + F.col("l")))
    start = F.greatest("at", "at2")
    both = met.select("pair", (F.col("i") + start - F.col("at")).alias("i"), (F.col("j2") + start - F.col("at2")).alias("j"), (F.least(F.col("at") + F.col("l"), F.col("at2") + F.col("l2")) - start).alias("l"))
    kind = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), "mov").when(F.col("i").isNotNull(), "del").otherwise("ins")
    return both.where(F.col("i").isNotNull() | F.col("j").isNotNull()).select("pair", kind.alias("kind"), "i", "j", "l")


def move_cost(edits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Words of every two moves that change places, multiplied, over the length of the text."""
    moves = edits.where("kind = 'mov'").select("pair", "i", "j", "l")
    other = moves.select("pair", *[F.col(c).alias(f"{c}2") for c in ("i", "j", "l")])
    crossed = moves.join(other, "pair").where("i < i2 and j > j2").groupBy("pair").agg(F.sum(F.col("l") * F.col("l2")).alias("crossed"))
    return lengths.join(crossed, "pair", "left").select("pair", (F.coalesce("crossed", F.lit(0)) / F.greatest("n", F.lit(1))).alias("cost"))


def uncovered(edits: DataFrame, lengths: DataFrame) -> DataFrame:
    """(pair, left, right): words of both texts that a list leaves open; ``lengths`` has pair, n_left and n_right."""
    return lengths.join(cover(edits), "pair", "left").select(
        "pair", (F.col("n_left") - F.coalesce("left_words", F.lit(0))).alias("left"), (F.col("n_right") - F.coalesce("right_words", F.lit(0))).alias("right")
    )


def best_intermediary(open_words: DataFrame, share: float = 0.20, most: int = 100) -> DataFrame:
    """Of the texts between two (pair, middle, left, right, n_left, n_right) the one whose composition leaves least open.

    What counts is the side that is covered better, and of equals the later
    middle.  None where that side has more than ``most`` words open, or more than that
    share of its words; both are counted with one more, for empty texts.
    """
    part = lambda side: (F.col(side) + 1) / (F.col(f"n_{side}") + 1)
    told = open_words.withColumn("open", F.least("left", "right"))
    fits = told.where((F.least(part("left"), part("right")) <= share) & (F.col("open") <= most) & (F.col("open") <= F.col("n_left") + F.col("n_right")))
    return fits.groupBy("pair").agg(F.min(F.struct("open", (-F.col("middle")).alias("last"))).alias("best")).select("pair", (-F.col("best.last")).alias("middle"), "best.open")


def _pairs_of(texts: pa.Array) -> pa.Array:
    """All texts of a slice at once: neighbours are sorted by (text, first, second), runs of equal ones are a pair's places."""
    sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = texts.flatten().dictionary_encode()
    codes, owner = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(owner[1:] == owner[:-1])
    at = at[np.lexsort((place[at], codes[at + 1], codes[at], owner[at]))]
    key = np.stack((owner[at], codes[at], codes[at + 1]))
    first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if len(at) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array([*first, len(at)], pa.int32()), pa.array(place[at], pa.int32()))
    pair = [words.dictionary.take(pa.array(key[k, first])) for k in (1, 2)]
    found = pa.StructArray.from_arrays([*pair, places], ["first", "second", "places"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(key[0, first], np.arange(len(sizes) + 1)), pa.int32()), found)


def adjacent_words(words: Column | str, most: int | None = None) -> Column:
    """Array of (first, second, places): where each two neighbouring words of a text stand; nothing is shuffled.

    ``most`` leaves out pairs with more places.
    """
    found = by_slices(_pairs_of, "array<struct<first:string,second:string,places:array<int>>>", words)
    return found if most is None else F.filter(found, lambda p: F.size(p["places"]) <= most)


def match_quality(l: Column, i1: Column, n1: Column, i2: Column, n2: Column, chunk: Column) -> Column:
    """A match's place in the order of matching, least first: the longer, the later chunk, the more alike the places of the middles."""
    middle = lambda i, n: F.try_divide(i + l / 2, n)
    return F.struct((-l).alias("length"), (-chunk).alias("chunk"), F.abs(middle(i1, n1) - middle(i2, n2)).alias("off"))
