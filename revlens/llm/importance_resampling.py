"""Importance resampling towards a target distribution over hashed n-grams.

One scan of each text keeps a ring of running CRC states, one for each of
the last ``n`` words as a start: the next word, with a blank before it,
extends them all, begins one of its own, and each state names the bucket of
its run of words.  The scan writes a document's buckets as one packed field;
all that follows reads these and never the texts again.

Buckets are counted for the corpus and for the target (a task sums what it
reads, so a hot bucket is one number a task).  A bucket's gain is the logarithm of
its share in the target over its share in the corpus, with one added to each
count; a document's weight is the sum over its features, and its score adds
Gumbel noise from a digest of its id, so that the highest scores are a draw
without replacement in proportion to the weights.  Ranks come from ranges of
the scores, not from one sorted task.

The vector of gains has ``buckets`` numbers, whatever the corpus; it is all that is
sent to every task.  Null and empty texts have no features and weigh 0, below
``least_words`` they are never drawn.  A null id draws its noise as an empty
one.  Rows that repeat an id share its noise; equal rows stand side by side.
Extra columns are ignored.  An empty target or corpus has counts of 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_texts
from .ordering import numbered

NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Fixed by the features' definition: what remains of UTF-8 once capitals are lowered and other ASCII is a gap.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def ring(words: Iterable[bytes], n: int) -> Iterator[int]:
    """The CRC-32 of every run of 1 to ``n`` words joined by blanks, in the order in which the runs end."""
    states: list[int] = []
    for word in words:
        spaced = b" " + word
        states = [crc32(word), *[crc32(spaced, state) for state in states[: n - 1]]]
        yield from states


def _packed(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _scanned(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, packed = [], []
        for text in batch["text"].to_pylist():
            words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower())
            n_words.append(len(words))
            packed.append((np.fromiter(ring(words, n), "<u4") % np.uint32(buckets)).astype(_packed(buckets)))
        columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array([len(p) for p in packed], pa.int64()), pa.array([p.tobytes() for p in packed], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])


def scan(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of every text."""
    return doc_texts(docs).mapInArrow(lambda it: _scanned(it, n, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for packed in batch["buckets"].to_pylist():
            counts += np.bincount(np.frombuffer(packed, _packed(buckets)), minlength=buckets)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], ["bucket", "n"])


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets with a feature."""
    parts = scanned.select("buckets").mapInArrow(lambda it: _counted(it, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, corpus: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from the counts of both sides: a vector of ``buckets`` numbers."""
    spark = corpus.sparkSession
    none = F.lit(0).cast("long")
    sides = target.select("bucket", F.col("n").alias("t"), none.alias("s")).unionByName(corpus.select("bucket", none.alias("t"), F.col("n").alias("s")))
    counts = cut(sides.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s")))
    total = counts.agg(F.coalesce(F.sum("t"), none).alias("t"), F.coalesce(F.sum("s"), none).alias("s")).first()
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    t, s = (F.col(c).cast("double") for c in ("t", "s"))
    gain = F.floor(1000 * F.log((t + 1) * (float(total["s"]) + buckets) / ((s + 1) * (float(total["t"]) + buckets))))
    vector = np.zeros(buckets, np.int64)
    for row in every.select("bucket", gain.cast("long").alias("gain")).collect():
        vector[row["bucket"]] = row["gain"]
    return vector


def weigh(scanned: DataFrame, vector: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and ``weight``, the sum of the gains of a document's features."""
    buckets = len(vector)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(vector[np.frombuffer(packed, _packed(buckets))].sum()) for packed in batch["buckets"].to_pylist()]
            kept = ["doc_id", "n_words", "n_features"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(weights, pa.int64())], [*kept, "weight"])

    return scanned.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    ``target`` has a column ``text``.
    """
    scanned = cut(scan(docs, n, buckets))
    aimed = scan(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    weighed = weigh(scanned, gains(bucket_counts(aimed, buckets), bucket_counts(scanned, buckets), buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))
    able = scored.where(F.col("n_words") >= least_words).withColumn("all", F.lit(0))
    placed = numbered(able, "all", F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features"))
    drawn = F.col("idx") < F.floor(F.col("n") * percent / 100)
    ranked = placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("idx") + 1).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
