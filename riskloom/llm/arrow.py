"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked on in runs of rows of about this many bytes, so that memory does not follow the batch.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` has about ``limit`` bytes; a longer value stands alone."""
    values = batch.column(column)
    if not len(values):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64))
    start = 0
    while start < len(values):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(values: pa.Array) -> list[str]:
    """The strings of a column; null is empty."""
    return [t or "" for t in values.to_pylist()]


def ragged(parts: Sequence[np.ndarray] | Sequence[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int32) and the joined values of byte strings that hold ``dtype`` items."""
    size = np.dtype(dtype).itemsize
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // size for p in parts], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(parts), dtype)
