"""Cutting Arrow batches of texts into slices of bounded bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices whose texts in ``column`` hold about ``limit`` bytes at most; a longer text comes alone."""
    for batch in batches:
        for lo, hi in ranges(batch.column(column), limit):
            yield batch.slice(lo, hi - lo)


def ranges(texts: pa.Array, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Row ranges of ``texts`` of about ``limit`` bytes each."""
    n = len(texts)
    if not n:
        return []
    ends = text_offsets(texts)[1:]
    out, lo, base = [], 0, int(text_offsets(texts)[0])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        out.append((lo, hi))
        lo, base = hi, int(ends[hi - 1])
    return out


def text_offsets(texts: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string or binary array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 offsets into it (null texts are empty)."""
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.empty(0, np.uint8)
    return raw, offsets - lo


def give_back() -> None:
    """Return memory that is free to the system, which else stays with a Python process for as long as it lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not a function of every C library
        pass
