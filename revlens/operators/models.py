"""Scores of revisions: alternating decision trees over the columns of ``features.revision_features``.

A tree is a start value and tests.  A test stands below a side of an earlier
one (or at the top), and adds one value if its feature is below its threshold and another
if it is not; the score is the sum over all tests that are reached.
Here the whole tree becomes one column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The trained trees.  Columns: test, stands below (test and side), feature, threshold, value below it, value else.
VANDALISM = (
    0.134,
    (1, None, "min_quality", "<", -0.662, 0.891, -1.203),
    (2, (1, "below"), "l_delta_hist0", "<", 0.347, -0.974, 0.151),
    (3, (1, "below"), "avg_quality", "<", -0.117, -0.002, -0.695),
    (4, None, "reputation", "<", 0.049, 0.358, 0.0),
    (5, (4, "below"), "p_prev_hist5", "<", 0.01, 0.519, -0.298),
    (6, (5, "else"), "l_delta_hist2", "<", 0.347, -1.125, 1.113),
    (7, (5, "else"), "avg_quality", "<", 0.156, 0.531, -2.379),
    (8, None, "logtime_next", "<", 2.97, 1.025, 0.035),
    (9, (8, "else"), "delta", "<", 3.741, -0.232, 0.212),
)
VANDALISM_AT_ONCE = (
    0.134,
    (1, None, "l_delta_hist0", "<", 0.347, -1.018, 0.766),
    (2, (1, "below"), "hist0", "<", 0.5, -0.113, 0.528),
    (3, (1, "else"), "l_delta_hist3", "<", 0.347, 0.026, -0.962),
    (4, (3, "below"), "l_delta_hist4", "<", 0.347, 0.1, -0.751),
    (5, (1, "else"), "p_prev_hist0", "<", 0.004, 0.094, -0.493),
    (6, None, "not_anon", "<", 0.5, -0.576, 0.312),
    (7, None, "p_prev_hist9", "<", 0.115, -0.333, 0.182),
    (8, (7, "else"), "hist7", "<", 1.5, 1.217, -0.029),
    (9, None, "delta", "<", 2.901, -0.251, 0.182),
    (10, None, "comment_len", "<", 18.5, 0.123, -0.229),
)
SELECTION = (
    0.134,
    (1, None, "min_quality", "<", -0.662, 0.891, -1.203),
    (2, (1, "below"), "l_delta_hist0", "<", 0.347, -0.974, 0.151),
    (3, (1, "below"), "max_dissent", "<", 0.171, -1.329, 0.086),
    (4, None, "reputation", "<", 0.049, 0.358, -1.012),
    (5, (4, "else"), "p_prev_hist5", "<", 0.01, 0.482, -0.376),
    (6, (5, "else"), "avg_quality", "<", 0.156, 0.5, -2.625),
    (7, (5, "else"), "l_delta_hist2", "<=", 0.347, 1.193, -0.757),
    (8, None, "logtime_next", "<", 2.74, 1.188, 0.045),
    (9, (8, "else"), "delta", "<", 3.741, -0.255, 0.168),
)
#: The variant of the web interface, which has the third test's threshold below zero.
SELECTION_WEB = (*SELECTION[:3], (3, (1, "below"), "max_dissent", "<", -0.171, -1.329, 0.086), *SELECTION[4:])
#: Seconds of age that discount a revision as much as one revision after it.
AGE_OF_A_REVISION = 7 * 24 * 3600.0


def tree_score(tree: tuple) -> Column:
    start, *tests = tree
    reached: dict[tuple[int, str], Column] = {}
    total = F.lit(start)
    for test, parent, feature, compare, threshold, low, high in tests:
        here = reached[parent] if parent else F.lit(True)
        # the 2 x 2 product of "reached" and "below" in one expression
        below = F.col(feature) <= threshold if compare == "<=" else F.col(feature) < threshold
        reached[test, "below"], reached[test, "else"] = here & below, here & ~below
        total = total + F.when(here, F.when(below, low).otherwise(high)).otherwise(0.0)
    return total


def vandalism(features: DataFrame) -> DataFrame:
    """``features`` with the probability ``vandalism`` that a revision is vandalism."""
    return features.withColumn("vandalism", 1 / (1 + F.exp(-tree_score(VANDALISM))))


def vandalism_at_once(features: DataFrame) -> DataFrame:
    """The same without what later revisions tell; needs ``comment_len``, 0 where a revision has no comment."""
    known = features.withColumn("not_anon", (~F.col("anon")).cast("int")).withColumn("comment_len", F.coalesce("comment_len", F.lit(0)))
    return known.withColumn("vandalism", 1 / (1 + F.exp(-tree_score(VANDALISM_AT_ONCE)))).drop("not_anon")


def selection_quality(features: DataFrame, tree: tuple = SELECTION) -> DataFrame:
    """``features`` with the probability ``quality`` that a revision is good."""
    return features.withColumn("quality", 1 / (1 + F.exp(tree_score(tree))))


def discount(past: Column, age: Column, base: float) -> Column:
    """What a revision counts that has ``past`` revisions from it on and is ``age`` seconds old."""
    return base / (base + past + age / AGE_OF_A_REVISION)
