"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are documents, columns their distinct word
shingles.  An entry of its product with its transpose counts shared
shingles; a link needs ``overlap >= t / (1 + t) * (n_a + n_b)``, so entries
whose bound cannot be reached are never formed.

1. Equal rows form a class, found by digests; one document of each class
   goes on.
2. Every column is counted over all classes.  The names of a shard of texts go to
   buckets of names and their counts come back, so a frequent column costs one
   entry per shard.  A row with fewer than ``t n`` columns that another class
   has can link with nothing and ends here.
3. The columns of the other rows are ordered by count, rarest first.  A linked pair shares a column
   among the first ``n - ceil(t n) + 1`` of either row, so only these *leading*
   columns list their rows.  A row that has a column at place p shares at most
   ``n - p`` columns with any row of that list, so its partners have at most
   ``reach = ((1 + t)(n - p) - t n) / t`` columns, and it has at most theirs.
4. In every list the row of greatest reach for its size is the hub, and the others are multiplied
   with it, each with the hub that it shares most lists with.  Links give
   components; a row stays in a list only if a row of another component, in reach
   of it, is there too.  As long as long lists remain, further rounds multiply
   their rows with more hubs, all of them; at last the few pairs left are formed.

The product takes blocks: a hub's row meets the rows of its partners in blocks of
bounded size, the overlap accumulates over blocks of columns, and a pair is
discarded as soon as what it has and what is left fall short.  A group of copies never expands into all its
pairs, yet every pair of different components that could link has been
multiplied or bounded.

Null or empty texts and rows without a doc_id have an empty set and link
with nothing.  ``doc_id`` is the key; rows that repeat an id come back once
each, with the component of that id, and join what any of them links with.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHARD_TEXTS, cut, doc_texts, encoded, free, mix, pressed, restored, run_names, sharded, slices, unpacked, window_hashes, word_hashes
from .components import components

WORDS = 5
THRESHOLD = (75, 100)
#: Columns for each bucket of names, and bits of a name within its bucket.  Columns that share these bits are
#: counted together, which can only keep a row for longer.
BUCKET_COLUMNS, NAME_BITS = 1 << 20, 25
#: Partners of one hub that are multiplied in one block.
BLOCK_ROWS = 500
COLUMN_BLOCKS = 4
#: Steps of the counts by which columns are ordered, for each doubling.
STEPS = 8

_SETS = "doc_id long, n_shingles long, d1 long, d2 long"
_REQUESTS = "bucket long, shard long, n int, names binary, counts binary"
_REPLIES = "bucket long, shard long, n int, levels binary"
_ROWS = "node long, doc_id long, n long, names array<long>"
_PRODUCT = "a long, b long, overlap long, n_a long, n_b long"
_DIGEST = ["n_shingles", "d1", "d2"]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle names of all texts in turn, number of each text)."""
    words, counts = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    names, at = window_hashes(words, counts, k)
    parts, owners = [names], [owner[at]]
    first = np.cumsum(counts) - counts
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            parts.append(run_names(words, size)[first[short]])
            owners.append(short)
    names, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    new = np.concatenate((np.ones(min(1, len(names)), bool), (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])))
    return names[new], np.bincount(owner[new], minlength=len(texts))


def _all_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [shingle_sets(texts[a:b], k) for a, b in slices(texts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sets(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    zero = np.zeros(1, np.uint64)
    for pdf in batches:
        texts = encoded(pdf["text"])
        for a, b in slices(texts):
            names, sizes = shingle_sets(texts[a:b], k)
            first = np.cumsum(sizes) - sizes
            sums = np.concatenate((zero, np.cumsum(names)))
            twice = np.concatenate((zero, np.cumsum(mix(names ^ np.uint64(0x5851F42D4C957F2D)))))
            d1, d2 = sums[first + sizes] - sums[first], twice[first + sizes] - twice[first]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].astype("Int64"), "n_shingles": sizes, "d1": d1.view(np.int64), "d2": d2.view(np.int64)})


# --- counting columns -------------------------------------------------------------


def _short(names: np.ndarray, log_buckets: int) -> np.ndarray:
    return names >> np.uint64(64 - NAME_BITS - log_buckets)


def _requests(batches: Iterator[pd.DataFrame], k: int, log_buckets: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for shard, sizes, texts in zip(pdf["shard"], pdf["sizes"], pdf["texts"], strict=True):
            distinct, counts = np.unique(_short(_all_sets(unpacked(sizes, texts), k)[0], log_buckets), return_counts=True)
            bucket = (distinct >> np.uint64(NAME_BITS)).astype(np.int64)
            low = distinct & np.uint64((1 << NAME_BITS) - 1)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
            rows = [(bucket[a], shard, b - a, pressed(np.diff(low[a:b], prepend=np.uint64(0))), pressed(counts[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", "shard", "n", "names", "counts"])


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each name that a shard sent 0 if a single class has it, else the step of its count."""
    names = np.concatenate([np.cumsum(restored(x, n)) for x, n in zip(pdf["names"], pdf["n"], strict=True)])
    counts = np.concatenate([restored(c, n) for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
    distinct, which = np.unique(names, return_inverse=True)
    total = np.bincount(which, counts, len(distinct))
    level = np.where(total > 1, np.floor(STEPS * np.log2(np.maximum(total, 1))), 0).astype(np.int64)[which]
    stops = np.cumsum([0, *pdf["n"]])
    return pd.DataFrame({"bucket": pdf["bucket"], "shard": pdf["shard"], "n": pdf["n"], "levels": [pressed(level[a:b]) for a, b in zip(stops, stops[1:], strict=False)]})


def _ordered(shards: pd.DataFrame, replies: pd.DataFrame, k: int, log_buckets: int, threshold: tuple[int, int]) -> pd.DataFrame:
    """The rows that share enough columns to link, with these columns in the common order."""
    t, of = threshold
    out = []
    for shard, ids, sizes, texts in zip(shards["shard"], shards["ids"], shards["sizes"], shards["texts"], strict=True):
        names, n = _all_sets(unpacked(sizes, texts), k)
        distinct, which = np.unique(_short(names, log_buckets), return_inverse=True)
        told = replies.sort_values("bucket")
        if int(told["n"].sum()) != len(distinct):
            raise ValueError("a bucket's answer is missing")
        if not len(distinct):
            continue
        level = np.concatenate([restored(b, m) for b, m in zip(told["levels"], told["n"], strict=True)])[which]
        owner = np.repeat(np.arange(len(n)), n)
        common = np.bincount(owner, level > 0, len(n)).astype(np.int64)
        able = (n > 0) & (of * common >= t * n)
        if not able.any():
            continue
        own = (level > 0) & able[owner]
        order = np.lexsort((names[own], level[own], owner[own]))
        rows = np.split(names[own][order].view(np.int64), np.cumsum(common[able])[:-1])
        out += [((shard * SHARD_TEXTS) + i, int(ids[i]), n[i], row) for i, row in zip(np.flatnonzero(able), rows, strict=True)]
    return pd.DataFrame(out, columns=["node", "doc_id", "n", "names"])


# --- the product ------------------------------------------------------------------


def _product(batches: Iterator[pd.DataFrame], threshold: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Overlaps of hubs with their partners, a block of columns at a time; rows come sorted, hubs first."""
    t, of = threshold
    edges = [np.uint64((i << 64) // COLUMN_BLOCKS) for i in range(1, COLUMN_BLOCKS)]
    key, hub_id, n_hub, hub, hub_cuts = None, None, 0, np.zeros(0, np.uint64), []
    for pdf in batches:
        out = []
        for h, block, doc_id, is_hub, n, names in zip(pdf["hub"], pdf["block"], pdf["doc_id"], pdf["is_hub"], pdf["n"], pdf["names"], strict=True):
            row = np.sort(np.asarray(names, np.int64).view(np.uint64))
            if is_hub:
                key, hub_id, n_hub, hub = (h, block), doc_id, n, row
                hub_cuts = [0, *np.searchsorted(hub, edges), len(hub)]
                continue
            if key != (h, block):
                raise ValueError(f"block {(h, block)} came without its hub")
            cuts = [0, *np.searchsorted(row, edges), len(row)]
            overlap = 0
            for c in range(COLUMN_BLOCKS):
                mine, theirs = row[cuts[c] : cuts[c + 1]], hub[hub_cuts[c] : hub_cuts[c + 1]]
                if len(mine) and len(theirs):
                    place = np.searchsorted(theirs, mine)
                    place[place == len(theirs)] = 0
                    overlap += int((theirs[place] == mine).sum())
                most = overlap + min(len(row) - cuts[c + 1], len(hub) - hub_cuts[c + 1])
                if of * most < t * (n + n_hub - most):
                    break
            else:
                out.append((hub_id, doc_id, overlap, n_hub, n))
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "overlap", "n_a", "n_b"])


def _multiply(rows: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of the pairs (hub, partner) of rows the links (a, b) of their documents."""
    width = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    partners = pairs.join(width, "hub").select("hub", F.col("partner").alias("node"), F.pmod(F.xxhash64("partner"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_hub"))
    hubs = width.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_hub"))
    dealt = rows.join(partners.unionByName(hubs), "node").select("hub", "block", "doc_id", "is_hub", "n", "names")
    dealt = dealt.repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("is_hub"))
    return dealt.mapInPandas(lambda it: _product(it, threshold), _PRODUCT).select("a", "b")


# --- lists of rows by leading column ----------------------------------------------


def _listed(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(column, node, doc_id, n, reach) for each leading column of each row; what only it has stands before all others."""
    t, of = threshold
    alone = F.col("n") - F.size("names")
    lead = F.col("n") - F.ceil(F.col("n") * t / of) + 1 - alone
    at = rows.select("node", "doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("names", 1, F.greatest(lead, F.lit(0)).cast("int"))).alias("place", "shingle"))
    reach = F.floor(((of + t) * (F.col("n") - F.col("alone") - F.col("place")) - t * F.col("n")) / t)
    return at.select("shingle", "node", "doc_id", "n", reach.alias("reach")).where("reach > 0")


def _placed(lists: DataFrame, near: DataFrame | None) -> DataFrame:
    """``lists`` with the component of each row as ``c``."""
    if near is None:
        return lists.withColumn("c", F.col("doc_id"))
    return lists.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of lists that another component's row of the list may link with."""
    by_component = placed.groupBy("shingle", "c").agg(F.max("reach").alias("reach"), F.min("n").alias("n"))
    best = by_component.groupBy("shingle").agg(F.max(F.struct("reach", "c")).alias("far"), F.min(F.struct("n", "c")).alias("small"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    best = best.where("lo <> hi").select("shingle", "far", "small")
    second = by_component.join(best, "shingle").groupBy("shingle").agg(
        F.first("far").alias("far"),
        F.first("small").alias("small"),
        F.max(F.when(F.col("c") != F.col("far.c"), F.col("reach"))).alias("far2"),
        F.min(F.when(F.col("c") != F.col("small.c"), F.col("n"))).alias("small2"),
    )
    far = F.when(F.col("c") == F.col("far.c"), F.col("far2")).otherwise(F.col("far.reach"))
    small = F.when(F.col("c") == F.col("small.c"), F.col("small2")).otherwise(F.col("small.n"))
    return placed.join(second, "shingle").where((far >= F.col("n")) & (small <= F.col("reach"))).select(*placed.columns)


def _hubs(placed: DataFrame, each: int) -> DataFrame:
    """The rows of greatest reach for their size, one of each of ``each`` parts of a list."""
    strength = F.floor(F.col("reach") * (1 << 20) / F.col("n"))
    best = placed.groupBy("shingle", F.pmod(F.xxhash64("node"), F.lit(each)).alias("part")).agg(F.max(F.struct(strength.alias("strength"), "node", "n", "reach", "c")).alias("h"))
    return best.select("shingle", *[F.col(f"h.{x}").alias(f"{x}_h") for x in ("node", "n", "reach", "c")])


def _in_reach(a: str, b: str) -> Column:
    return (F.col(f"n{a}") <= F.col(f"reach{b}")) & (F.col(f"n{b}") <= F.col(f"reach{a}")) & (F.col(f"c{a}") != F.col(f"c{b}"))


def _links(rows: DataFrame, lists: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) of documents, enough of all links to give the components; and these, if they are known."""
    total = lists.count()
    pairs = lists.join(_hubs(_placed(lists, None), 1).drop("c_h"), "shingle").where("node <> node_h and n <= reach_h and n_h <= reach")
    most = pairs.groupBy("node", "node_h").agg(F.count("*").alias("shared")).groupBy("node").agg(F.max(F.struct("shared", "node_h")).alias("best"))
    tested = cut(most.select(F.col("best.node_h").alias("hub"), F.col("node").alias("partner")))
    links = cut(_multiply(rows, tested, threshold))
    each = 1
    while True:
        near = cut(components(links))
        left = cut(_open(_placed(lists, near)))
        size = left.groupBy("shingle").agg(F.count("*").alias("n"))
        pairs_left = size.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()[0]
        if not pairs_left:
            return links, near
        last = pairs_left <= total
        if last:
            a, b = (left.select("shingle", *[F.col(x).alias(f"{x}{s}") for x in ("node", "n", "reach", "c")]) for s in ("_a", "_b"))
            pairs = a.join(b, "shingle").where(F.col("node_a") < F.col("node_b")).where(_in_reach("_a", "_b")).select(F.col("node_a").alias("hub"), F.col("node_b").alias("partner"))
        else:
            hubs = cut(_hubs(left, each))
            pairs = left.join(hubs, "shingle").where(F.col("node") != F.col("node_h")).where(_in_reach("", "_h")).select(F.col("node_h").alias("hub"), F.col("node").alias("partner"))
        known = tested.union(tested.select(F.col("partner").alias("hub"), F.col("hub").alias("partner")))
        pairs = cut(pairs.distinct().join(known, ["hub", "partner"], "left_anti"))
        more = cut(_multiply(rows, pairs, threshold))
        if last and more.isEmpty():
            return links, near
        links = links.union(more)
        if last:
            return links, None
        tested = tested.union(pairs)
        # all that a hub could link with in its list has been multiplied
        lists = cut(left.drop("c").join(hubs.select("shingle", F.col("node_h").alias("node")), ["shingle", "node"], "left_anti"))
        each *= 2


def jaccard_components(docs: DataFrame, k: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of ``threshold[0] / threshold[1]`` at least.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links, itself included), one row per row of ``docs``.
    """
    docs = doc_texts(docs)
    found = cut(docs.mapInPandas(lambda it: _sets(it, k), _SETS))
    known = found.where("doc_id is not null and n_shingles > 0")
    classes = cut(known.groupBy(*_DIGEST).agg(F.min("doc_id").alias("a")))
    columns = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    log_buckets = min(64 - NAME_BITS, max(4, int(np.ceil(np.log2(max(1, columns / BUCKET_COLUMNS))))))

    shards = cut(sharded(docs.join(classes.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    replies = shards.mapInPandas(lambda it: _requests(it, k, log_buckets), _REQUESTS).groupBy("bucket").applyInPandas(_levels, _REPLIES)
    rows = cut(shards.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(lambda a, b: _ordered(a, b, k, log_buckets, threshold), _ROWS))
    free(shards)
    lists = cut(_listed(rows, threshold))

    # an id that repeats with other texts joins their classes
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    of_repeated = known.join(repeated, "doc_id").join(classes, _DIGEST).select("doc_id", "a")
    joined = cut(of_repeated.select(F.col("doc_id").alias("a"), F.col("a").alias("b")).where("a <> b").distinct())
    links, near = _links(rows, lists, threshold)
    if near is None or not joined.isEmpty():
        near = cut(components(links.union(joined)))
    of_class = classes.join(near.withColumnRenamed("node", "a"), "a", "left").select(*_DIGEST, F.coalesce("component", "a").alias("component_id"))
    named = known.join(of_class, _DIGEST).select("doc_id", "n_shingles", "component_id")
    empty = found.where("doc_id is null or n_shingles = 0").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.union(empty.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
