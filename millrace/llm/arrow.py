"""Small helpers for ``mapInArrow`` functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that ``column`` holds about ``most_bytes`` in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(column).nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def binary_lists(parts: list[bytes], item: pa.DataType, width: int) -> pa.ListArray:
    """A list column from each row's items as little-endian bytes."""
    import numpy as np

    ends = np.cumsum([0, *[len(x) // width for x in parts]], dtype=np.int64).astype(np.int32)
    values = pa.Array.from_buffers(item, int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def release() -> None:
    """Give freed memory back to the system: workers live on, and what they keep is not the next operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)
