"""Reading the document table, word splitting and 64-bit hashing shared by the corpus operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Those bytes
never occur inside a multi-byte UTF-8 character, so whole batches of
texts are split and hashed as one byte array with numpy.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text hashed at a time; bounds the temporary arrays to about ten times this.
SLICE_BYTES = 1 << 20
#: Rows in one Arrow batch of texts.
BATCH_ROWS = 2_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; a null text is an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` under names that clash with nothing, and what gives them their names and order back."""
    aside = {c: f"_other_{i}" for i, c in enumerate(docs.columns) if c not in own}
    columns = docs.columns
    return docs.select(*[quoted(c).alias(aside.get(c, c)) for c in columns]), lambda df: df.select(*[F.col(aside.get(c, c)).alias(c) for c in columns])


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small: a batch of texts is in memory several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in local tests, a folder of this machine if all tasks run on it."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (xor-shift and multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each span: cheap at every byte, for candidates that are compared afterwards.

    Texts can be built whose spans collide; what must tell contents apart takes ``byte_names`` and ``range_names``.
    """
    n = len(values)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _SIZE)


_SIZE, _FIRST, _STEP = (np.uint64(x) for x in (0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit names of spans of bytes: every eight bytes are mixed with their place, then all of them with the length.

    Names of two salts are independent of each other.
    """
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    first_salt, salts = (np.uint64(x % (1 << 64)) for x in (int(_FIRST) + salt * int(_STEP), salt * int(_FIRST)))
    h = mix((lanes[start] & _MASKS[np.minimum(size, 8)]) ^ first_salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # lanes behind the first
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[long], more) + 8 * place
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        h[long] += np.add.reduceat(mix((lanes[at] & _MASKS[left]) ^ mix(place.astype(np.uint64) * _SIZE + salts)), first)
    return mix(h + size.astype(np.uint64) * _SIZE)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def run_names(names: np.ndarray, k: int) -> np.ndarray:
    """The name of ``names[i : i + k]`` for every i, put together from runs of 1, 2, 4 ... names."""
    n, taken, size, rest = len(names) - k + 1, 0, 1, k
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, level = np.full(n, k, np.uint64), names
    while True:
        if rest & 1:
            out = _joined(out, level[taken : taken + n])
            taken += size
        rest >>= 1
        if not rest:
            return out
        level = _joined(level[:-size], level[size:])
        size *= 2


def range_names(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The name of ``names[start:end]`` for spans of at least one: two runs of a power of two that cover it, and its length."""
    length = end - start
    step = np.frexp(length.astype(np.float64))[1] - 1
    out, level, size = np.zeros(len(start), np.uint64), names, 1
    for k in range(int(step.max(initial=0)) + 1):
        own = np.flatnonzero(step == k)
        out[own] = _joined(_joined(level[start[own]], level[end[own] - size]), length[own].astype(np.uint64))
        level = _joined(level[:-size], level[size:])
        size *= 2
    return out


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Index ranges of ``texts`` of about ``limit`` bytes each (a longer text is alone)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def split_words(texts: list[bytes], lower: bool = False, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, word starts, word ends, number of words of each text); ``gap`` marks the bytes between words."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate(([True], gap[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, stops))))
    return data, start, end, counts


def word_hashes(texts: list[bytes], lower: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name of every word, number of words of each text)."""
    data, start, end, counts = split_words(texts, lower)
    return byte_names(data, start, end, salt), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, index of the first word) of every window of ``k`` words within one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return run_names(words, k)[at], at


def encoded(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column]


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder (or at ``path``), and go on from what was written.

    The shuffles that led to it are deleted with the end of the write, so that
    executors' disks hold those of one step at a time.
    """
    import uuid

    spark = df.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


#: Spark's setting for deleting the shuffles of a statement when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def free(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to be computed reads them."""
    for df in frames:
        ref, path = _WRITTEN.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


# --- texts in shards ---------------------------------------------------------

SHARD_BYTES, SHARD_TEXTS = 4 << 20, 1 << 16
SHARDS = "shard long, n_tokens long, ids array<long>, sizes array<int>, texts binary"


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 20
    press = zstandard.ZstdCompressor(level=4)
    ids, texts, size, tokens = [], [], 0, 0

    def row():
        return pd.DataFrame({"shard": [number], "n_tokens": [tokens], "ids": [ids], "sizes": [[len(t) for t in texts]], "texts": [press.compress(b"".join(texts))]})

    for pdf in batches:
        for d, t in zip(pdf["doc_id"], encoded(pdf["text"]), strict=True):
            ids.append(None if pd.isna(d) else int(d))
            texts.append(t)
            size += len(t)
            tokens += t.count(b" ") + 2
            if size >= SHARD_BYTES or len(texts) >= SHARD_TEXTS:
                yield row()
                ids, texts, size, tokens, number = [], [], 0, 0, number + 1
    if texts:
        yield row()


def sharded(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) packed some megabytes to a row; a text's number is ``shard * SHARD_TEXTS`` and its place."""
    return docs.select("doc_id", "text").mapInPandas(_sharded, SHARDS)


def unpacked(sizes, packed: bytes) -> list[bytes]:
    """The texts of a shard."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    stops = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def pressed(a: np.ndarray) -> bytes:
    """Unsigned values as planes of bytes, compressed; small and alike values cost little."""
    import zstandard

    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = a.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def restored(b: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pressed`` packed, as unsigned 64-bit numbers."""
    import zstandard

    out = np.zeros((n, 8), "u1")
    if n:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "u1").reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()
