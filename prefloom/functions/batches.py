"""Arrow batches in slices of bounded weight, so that the memory of a worker does not follow the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text, or elements of lists, that are worked on at once
AT_ONCE = 1 << 19


def weights(column: pa.Array) -> np.ndarray:
    """Bytes of texts or elements of lists; 0 for a null."""
    count = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(count(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def light(weight: np.ndarray, limit: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices in order that weigh at most ``limit``, or are one row."""
    ends = np.cumsum(weight)
    start = 0
    while start < len(weight):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop - start
        start = stop
