"""Arrow string columns as numpy arrays of bytes, in blocks of bounded size, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text stands alone.
BLOCK_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 places where texts begin, of a string array without nulls, without a copy."""
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def texts_of(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """The string array of these bytes and places."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about BLOCK_BYTES of texts, or one longer text."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // BLOCK_BYTES
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(size) else np.array([0])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.slice(a, b - a)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
