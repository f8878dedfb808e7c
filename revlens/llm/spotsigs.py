"""Document fingerprints by SpotSigs, with DataFrame functions only.

A common word is an anchor; it and the chain of the next ``CHAIN`` content
words (looked for among the next ``SPAN`` words) form a signature, a 32-bit
hash.  A document's fingerprint is the ascending list of its distinct signatures as
hexadecimal.  A text without a signature is its whole word sequence as one.

Fingerprints fall into partitions by set length whose bounds grow by
``1 / LIKE``; two that are ``LIKE`` alike are in one or in neighbouring partitions.
``likeness`` is the Jaccard similarity; with a least value of interest it
first compares the lengths and skips the intersection where they already
rule it out.

Null texts are empty: no signature, an empty fingerprint.  Two empty
fingerprints are alike (1), an empty and another are not (0).  The next
document follows by (doc_id, hash of the text); rows without a doc_id come
last.  A table of one row is its own next document.  Extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

CHAIN, SPAN = 3, 12
LIKE = 0.75
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS = 8

# Common words that serve as anchors, of several languages.
ANCHORS = (
    "a an and are as at be by for from have in is it of on or that the this to was with "
    "das den der des die ein eine für im ist mit nicht sich und von zu "
    "con de del el en es la las lo los no para por que se un una y "
    "au ce dans des du et il la le les ne pas pour que qui sur une"
).split()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """The ascending distinct signatures of a text (array<long> of 32-bit values)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    anchors = list(dict.fromkeys(ANCHORS))

    def chained(ws: Column) -> Column:
        def spot(w: Column, i: Column) -> Column:
            content = F.slice(F.filter(F.slice(ws, i + 2, SPAN), lambda x: ~x.isin(anchors)), 1, CHAIN)
            return F.when(w.isin(anchors), _let(content, lambda c: F.when(F.size(c) > 0, F.xxhash64(F.concat_ws(" ", w, c)))))

        found = F.filter(F.transform(ws, spot), lambda s: s.isNotNull())
        whole = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", F.lit("whole:"), ws)))).otherwise(F.expr("array()").cast("array<bigint>"))
        return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    return _let(words, lambda ws: F.array_sort(F.array_distinct(F.transform(chained(ws), lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF))))))


def fingerprint(signed: Column) -> Column:
    return F.array_join(F.transform(signed, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def length_part(signed: Column) -> Column:
    """Number of the partition by set length; 0 for an empty set."""
    return F.floor(F.log(F.greatest(F.size(signed), F.lit(1))) / math.log(1 / LIKE)).cast("int") + F.when(F.size(signed) > 0, 1).otherwise(0)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where the lengths alone keep it under ``at_least``."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    exact = _let(shared, lambda s: s / (F.size(a) + F.size(b) - s))
    return F.when(most == 0, 1.0).when((least == 0) | (least < at_least * most), 0.0).otherwise(exact)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with a bucket of neighbouring ids, and each bucket's first row once more as the ``tail`` of the one before.

    The bounds are ids of the table, so every bucket begins with a known one.
    """
    shares = [i / buckets for i in range(buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets)).alias("b"), F.min("doc_id").alias("m")).first()
    bounds = sorted({*(found["b"] or []), *([found["m"]] if found["m"] is not None else [])})
    if not bounds:  # no row has an id
        return rows.withColumn("bucket", F.lit(0)).withColumn("tail", F.lit(False))
    step = math.isqrt(len(bounds)) + 1
    all_bounds, coarse = F.lit(bounds).cast("array<bigint>"), F.lit(bounds[::step]).cast("array<bigint>")
    near = (F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1) * step
    bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(near + F.size(F.filter(F.slice(all_bounds, near + 1, step), lambda b: b <= F.col("doc_id"))))
    placed = rows.withColumn("bucket", bucket.cast("int"))
    before = F.when(F.col("bucket") == 1, len(bounds)).otherwise(F.col("bucket") - 1)
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    twice = F.array(home, F.struct(before.alias("bucket"), F.lit(True).alias("tail")))
    is_first = F.element_at(all_bounds, F.greatest(F.col("bucket"), F.lit(1))) == F.col("doc_id")
    places = F.when(is_first, twice).otherwise(F.array(home))
    return placed.withColumn("place", F.explode(places)).select("doc_id", "text", "signed", "place.bucket", "place.tail")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited form, with the likeness of neighbours.

    The edited text has the last half (rounded down) replaced by as many
    first code points of the next document.  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    length_part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("signed", signatures(F.col("text")))
    dealt = _dealt(rows, BUCKETS * shuffle_partitions(docs.sparkSession))
    by_id = Window.partitionBy("bucket").orderBy("tail", F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    follower = F.coalesce(F.lead(F.struct("text", "signed")).over(by_id), F.struct("text", "signed"))
    rows = dealt.withColumn("after", follower).where(~F.col("tail"))
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(after.text, int(length(text) div 2))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "signed", F.col("after.signed").alias("next_signed"), edited.alias("edited"))
    rows = rows.withColumn("edited_signed", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signed")).alias("fingerprint"),
        fingerprint(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"),
        likeness(F.col("signed"), F.col("next_signed")).alias("near_next"),
        length_part(F.col("signed")).alias("length_part"),
    )
