"""A Merkle manifest of a table, kept as an external node store.

Leaves are hashed in one scan, sorted by ranges of (group, id) and written as
runs of ``FANOUT`` siblings: level 0 of a store of Parquet folders, one a
level.  Every further level reads the one before in its order, hashes each
run and writes the digests as runs again, until each group has one node.
Those subroots, in the order of their groups, are the leaves of a second,
small store, whose single node is the root.

Proofs go the other way: from the root down, the runs of a level meet the
paths of their parents by coordinate (group, place) in a merge join, and
each node's path is its siblings and the path of its parent.  Upper paths are
joined once for a run, so a level moves an eighth of the rows below it, and
no group is ever in one task.

Everything is DataFrame functions.  A digest is lowercase hex; a null field
counts as ``-``.  Rows that repeat an id follow each other by digest; null
ids come first, are not tampered with, and a null group comes before all
others.  Extra columns are ignored.  An empty table has no root and no rows.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, shared_folder
from .ordering import numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as a leaf holds it: its size in bytes and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class Store:
    """``levels[l]``: a row for each run of level l: key, idx (its parent's place), n (the key's nodes on the level), run."""

    levels: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """The last node of every key."""
        found = [level.where("n = 1").select("key", F.col("run")[0]["digest"].alias("digest")) for level in self.levels]
        return _united(found)

    def paths(self, ends: DataFrame, carried: Sequence[str], down_to: int = 0) -> DataFrame:
        """(key, idx, run's fields, path, ``carried``) of every node of a level.

        ``ends`` has a row for each key: the path of its last node, and columns that all its nodes get.
        """
        below = None
        for level in reversed(self.levels[down_to:]):
            met = [level.where("n = 1").join(ends, "key")]
            if below is not None:
                met.append(level.where("n > 1").join(below.select("key", "idx", "path", *carried), ["key", "idx"]))
            digests = F.col("run.digest")
            beside = F.struct(
                F.array_join(F.slice(digests, F.lit(1), F.col("pos")), "").alias("before"),
                F.array_join(F.slice(digests, F.col("pos") + 2, F.lit(self.fanout)), "").alias("after"),
            )
            nodes = _united([m.select("key", "idx", "n", "run", "path", *carried) for m in met]).select("*", F.posexplode("run").alias("pos", "node"))
            path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(beside), "path")).cast(_PATH)
            below = nodes.select("key", (F.col("idx") * self.fanout + F.col("pos")).alias("idx"), "node.*", path.alias("path"), *carried)
        return below


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build(leaves: DataFrame, order: Sequence[Column], fanout: int = FANOUT) -> Store:
    """The store over ``leaves`` (key, digest and any other columns) in the order given within each key."""
    spark = leaves.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/manifests/{uuid.uuid4().hex}"
    levels: list[DataFrame] = []

    def write(nodes: DataFrame) -> None:
        inner = [c for c in nodes.columns if c not in ("key", "idx", "n")]
        placed = nodes.withColumn("place", F.col("idx") % fanout).withColumn("idx", F.expr(f"idx div {fanout}"))
        runs = placed.repartitionByRange("key", "idx").groupBy("key", "idx").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", *inner))).alias("run"))
        kept = F.transform("run", lambda x: F.struct(*[x[c].alias(c) for c in inner]))
        levels.append(cut(runs.withColumn("run", kept).sortWithinPartitions("key", "idx"), f"{folder}/level={len(levels)}"))

    write(numbered(leaves, "key", *order))
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        hashed = F.sha2(F.array_join("run.digest", ""), 256)
        write(levels[-1].where("n > 1").select("key", "idx", F.ceil(F.col("n") / fanout).alias("n"), hashed.alias("digest")))
        most = -(-most // fanout)
    return Store(levels, fanout)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["before"], node, beside["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, leaf level first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda b: F.concat(b["before"], b["after"])), ""), 256)


def prove(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: order column, leaf, altered, path, subroot, root.

    ``altered`` is the leaf of the row with its text's capitals A-Z lowered where 3 divides the crc32 of its id, and null elsewhere.
    """
    whole = [field(quoted(c)) for c in fields]
    lowered = [field(lower_ascii(quoted(c))) if c == "text" else field(quoted(c)) for c in fields]
    hit = F.coalesce(F.crc32(quoted(order).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    leaves = cut(docs.select(key.alias("key"), quoted(order).alias("id"), digest(*whole).alias("digest"), F.when(hit, digest(*lowered)).alias("altered")))
    store = build(leaves, [F.col("id").asc_nulls_first(), F.col("digest")], fanout)
    groups = store.tops().select(F.lit("").alias("key"), F.col("key").alias("of"), "digest")
    upper = build(groups, [F.col("of")], fanout)
    root = upper.tops().select("key", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    ends = cut(upper.paths(root, ["root"]).select(F.col("of").alias("key"), "path", F.col("digest").alias("subroot"), "root"))
    return store.paths(ends, ["subroot", "root"]).select(F.col("id").alias(order), F.col("digest").alias("leaf"), "altered", "path", "subroot", "root")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    proven = prove(docs).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    verified = F.col("folded_root") == F.col("root")
    return proven.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", verified.alias("verified"))
