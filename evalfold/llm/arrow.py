"""Arrow columns of text as bytes, for the operators that work on whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(column: pa.Array) -> pa.Array:
    """A string column as large binary (UTF-8); nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())


def texts(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; nulls become empty."""
    return utf8(column).to_pylist()


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `size` bytes: the first row's number, the bytes, and the rows' offsets in them (one more than rows)."""
    a = utf8(column)
    n = len(a)
    if not n:
        return
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with columns set (replaced where the name exists)."""
    columns = dict(zip(batch.schema.names, batch.columns)) | new
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
