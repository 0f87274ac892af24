"""Arrow batches of texts as flat byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


def release() -> None:
    """Give freed memory back to the system, where allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def slices(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``step`` text bytes."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(np.asarray(length, dtype=np.int64))
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + step, side="right")))
        yield batch.slice(at, end - at)
        at = end
    release()  # a worker outlives its tasks


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row (null: none) and the n + 1 offsets into them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes; ``offsets`` are byte positions in ``data``."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
