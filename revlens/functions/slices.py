"""Column functions in Python that hold a slice of a batch at a time.

A batch has up to 10,000 rows, however long; what Python makes of long texts takes many times their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one slice, unless a single row has more.
SLICE_BYTES = 256 << 10


def _row_bytes(column: pa.Array) -> np.ndarray:
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        lengths = pc.binary_length(column)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        lengths = pc.multiply(pc.list_value_length(column), 16)
    else:
        return np.full(len(column), 8)
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(columns: tuple[pa.Array, ...]) -> list[tuple[int, int]]:
    """(start, rows) of the slices of a batch."""
    sizes = np.sum([_row_bytes(c) for c in columns], axis=0)
    slots = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(sizes)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def by_slices(function: Callable[..., pa.Array], returns: str, *columns: Column | str) -> Column:
    """``function`` of Arrow columns, called for one slice of rows after the other; each slice's result goes out by itself."""

    def sliced(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            given = batch if isinstance(batch, tuple) else (batch,)
            for start, n in cuts(given):
                yield function(*[c.slice(start, n) for c in given])

    # names of types, as this module's annotations are text
    sliced.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(sliced, returns)(*columns)
