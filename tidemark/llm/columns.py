"""Arrow columns as numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and len + 1 offsets. A null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    """A list column from row offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. (count numbers) for each start, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def text_column(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or that field of the first column, a row."""
    at = batch.schema.get_field_index("text")
    if at >= 0:
        return batch.column(at)
    row = batch.column(0)
    return row.field(row.type.get_field_index("text"))


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that a piece holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = utf8(text_column(batch))
        first = 0
        while first < len(batch):
            after = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            after = max(first + 1, min(after, len(batch)))
            yield batch.slice(first, after - first)
            first = after
        pa.default_memory_pool().release_unused()
