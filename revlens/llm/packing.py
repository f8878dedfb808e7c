"""Packing by multiway differencing (Karmarkar and Karp).

Each text becomes token ids in one pass; a text of more than a window is cut
into full windows and a rest.  Rests are packed in blocks of ``BLOCK`` pieces.  A
block of k windows starts as one partial partition for each piece (that
piece in one window, k - 1 empty ones); the two partitions of largest spread are merged
again and again, the fullest window of one with the emptiest of the other,
so imbalances cancel and the windows come out near equal.  k is the least count whose
windows could hold the block; when a window comes out over capacity, k rises
by one and the block is done again.

Blocks are formed inside a task from the documents it reads, so nothing is
shuffled.  A task's last, smaller block is packed in the same way; if that leaves
it one window, its pieces are cut at powers of two, at which a sequence
needs no padding.

Tokens come from a public tokenizer file; its pre-tokenizer never joins
characters across ASCII white space, so words are encoded once and reused.
Null texts are empty (only the end id).  Rows without a doc_id are packed too.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _LOWER, doc_texts, slices

CAPACITY = 4096
END = 2
BLOCK = 256
#: Words after which a Python worker forgets their ids and starts anew.
CACHE_WORDS = 800_000
#: Bytes of text encoded at a time.
SLICE = 4 << 20

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Index(dict):
    """Numbers for words; new ones are noted."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Token ids of whole texts; each distinct word is encoded once and its ids kept in one array.

    A word here is what the pre-tokenizer makes of a run of bytes between white space: a run of letters, a
    digit, or a run of other characters, in lower case.  Runs with bytes outside ``_PLAIN``, or with a mark of
    an added token, are words as they stand, and the tokenizer's own rules see them whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.store, self.first, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _keep(self, words: list[bytes]) -> None:
        flat, sizes = self._encode_new(words)
        at = len(self.index) - len(words)
        for name, need in (("store", self.used + len(flat)), ("first", len(self.index)), ("size", len(self.index))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate((have, np.zeros(need - len(have) // 2, have.dtype))))
        self.store[self.used : self.used + len(flat)] = flat
        self.first[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(words)] = sizes
        self.used += len(flat)

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number in each.

        Plain words are encoded as one text: each is one pre-token, which the token with a word end closes.
        """
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(ends, _odd_places(data), side="right")] = True
        plain = [w for w, o in zip(words, odd.tolist(), strict=True) if not o]
        flat = np.array(self._ids([b" ".join(plain)])[0], "<u4") if plain else np.zeros(0, "<u4")
        sizes = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(sizes) == len(plain) and sizes.sum() == len(flat) and not odd.any():
            return flat, sizes
        if len(sizes) != len(plain) or sizes.sum() != len(flat):
            plain, odd = [], np.ones(len(words), bool)
            flat, sizes = flat[:0], sizes[:0]
        # ids and sizes of the odd words behind those of the plain ones, then all in the order of the words
        lists = self._ids([w for w, o in zip(words, odd.tolist(), strict=True) if o])
        flat = np.concatenate((flat, np.array(list(chain.from_iterable(lists)), "<u4")))
        sizes = np.concatenate((sizes, np.array([len(x) for x in lists], np.int64)))
        stops = np.cumsum(sizes)
        order = np.empty(len(words), np.int64)
        order[np.flatnonzero(~odd)], order[np.flatnonzero(odd)] = np.arange(len(plain)), np.arange(len(plain), len(words))
        return flat[_ranges(stops[order] - sizes[order], sizes[order])], sizes[order]

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.clear()
        distinct, numbers, counts = _words(texts)
        words = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[numbers]
        if self.index.new:
            self._keep(self.index.new)
            self.index.new = []
        sizes = self.size[words]
        flat = self.store[_ranges(self.first[words], sizes)]
        edge = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b] for a, b in zip(edge, edge[1:], strict=False)]


#: Kinds of bytes: white space, letters (the two bytes of U+00C0 to U+00FF among them), digits, others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = 1
_KIND[48:58] = 2
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 11, 12, 13, *range(32, 127), *range(128, 192), 0xC3]] = True
_PLAIN[ord("'")] = False


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Places of bytes that only the tokenizer's own rules judge: apostrophes, controls, the added tokens' ``<|``, all but ASCII and U+00C0 to U+00FF, of these the two signs."""
    odd = ~_PLAIN[data]
    after = np.flatnonzero(data[:-1] == 0xC3)
    odd[after] |= (data[after + 1] == 0x97) | (data[after + 1] == 0xB7)
    after = np.flatnonzero(data[:-1] == ord("<"))
    odd[after] |= data[after + 1] == ord("|")
    return np.flatnonzero(odd)


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, for each word of the texts its number among these, number of words of each text)."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    kind = _KIND[data]
    lower = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    lower[after[data[after] <= 0x9E]] += 32
    odd = _odd_places(data)
    if len(odd):
        edge = np.diff(kind == 0, prepend=True, append=True)
        edges = np.flatnonzero(edge).reshape(-1, 2)
        runs = edges[np.unique(np.searchsorted(edges[:, 0], odd, side="right") - 1)]
        for a, b in runs.tolist():
            kind[a:b] = 4
            lower[a:b] = data[a:b]
    new = np.diff(kind, prepend=np.uint8(0)) != 0
    new |= kind == 2
    new &= kind != 0
    full = kind != 0
    start = np.flatnonzero(new[full])
    counts = np.diff(np.searchsorted(np.flatnonzero(new), np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    flat = lower[full]
    offsets = np.append(start, len(flat)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), counts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` (``size[i]`` numbers) for every i."""
    stops = np.cumsum(size, dtype=np.int64)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(start - stops + size, size)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition the items into k sets with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, x in enumerate(sizes):
        heap.append((-x, i, [x], [[i]]))  # spread, tie, sums and sets of the windows in use, largest first
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        # largest of one onto smallest of the other; windows not in use are empty
        overlap = len(sums_a) + len(sums_b) - k
        if overlap <= 0:
            pairs = list(zip(sums_a, sets_a, strict=True)) + list(zip(sums_b, sets_b, strict=True))
        else:
            n = len(sums_a)
            pairs = list(zip(sums_a[: n - overlap], sets_a[: n - overlap], strict=True))
            tail_b = len(sums_b) - overlap
            pairs += list(zip(sums_b[:tail_b], sets_b[:tail_b], strict=True))
            for j in range(overlap):
                a, b = n - 1 - j, tail_b + j
                pairs.append((sums_a[n - overlap + j] + sums_b[len(sums_b) - 1 - j], sets_a[n - overlap + j] + sets_b[len(sets_b) - 1 - j]))
        pairs.sort(key=lambda p: -p[0])
        sums, sets = [p[0] for p in pairs], [p[1] for p in pairs]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, sets))
        tie += 1
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of items of at most ``capacity`` in sum; as few as differencing reaches."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = _difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        k += 1


def _pack(batches: Iterator[pd.DataFrame], path: str, capacity: int, block: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    encode = encoder(path).encode
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 40
    rests: list[tuple] = []

    def packed(items: list[tuple], last: bool):
        nonlocal number
        sizes = [len(x[2]) for x in items]
        sets = windows(sizes, capacity)
        if last and len(sets) == 1:
            flat = [items[i] for i in sets[0]]
            left, room, at, i = sum(sizes), 0, 0, 0
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                offset = 0
                while room:
                    doc, start, ids, total = flat[i]
                    take = min(room, len(ids) - at)
                    yield piece(doc, start + at, ids[at : at + take], total, number, offset)
                    offset, room, at = offset + take, room - take, at + take
                    if at == len(ids):
                        i, at = i + 1, 0
                number += 1
            return
        for members in sets:
            offset = 0
            for i in members:
                doc, start, ids, total = items[i]
                yield piece(doc, start, ids, total, number, offset)
                offset += len(ids)
            number += 1

    def piece(doc, start, ids, total, sequence, offset):
        return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)

    for pdf in batches:
        docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        for a, b in slices(texts, SLICE):
            out = []
            for doc, ids in zip(docs[a:b], encode(texts[a:b]), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4", copy=False)
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    out.append(piece(doc, at, ids[at : at + capacity], len(ids), number, 0))
                    number += 1
                if full < len(ids):
                    rests.append((doc, full, ids[full:], len(ids)))
                if len(rests) >= block:
                    out += packed(rests, False)
                    rests.clear()
            if out:
                yield _frame(out)
    if rests:
        yield _frame(list(packed(rests, True)))
    if len(encoder(path).index) > CACHE_WORDS // 2:
        encoder(path).clear()  # workers are reused by other stages


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(names, columns, strict=True)})


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    return doc_texts(docs).mapInPandas(lambda it: _pack(it, path, capacity, block), _SCHEMA)
