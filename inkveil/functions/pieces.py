"""Arrow batches taken in small pieces, so that a Python worker holds the results of a few rows, not of a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows of about PIECE_BYTES in ``column`` (strings, bytes, or lists of them); a longer row is
    a run of its own."""
    if pa.types.is_list(column.type):
        inner, at = pc.binary_length(column.values).fill_null(0).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sums = np.concatenate([[0], np.cumsum(inner, dtype=np.int64)])
        sizes = sums[at[1:]] - sums[at[:-1]]
    else:
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > PIECE_BYTES:
            yield begin, i - begin
            begin, held = i, 0
        held += size
    if begin < len(column):
        yield begin, len(column) - begin


def each_row(batches: Iterator[tuple[pa.Array, ...]], work: Callable, out: pa.DataType) -> Iterator[pa.Array]:
    """``work`` of the Python values of every row; one result array for each piece of the batches."""
    for columns in batches:
        for lo, n in pieces(columns[0]):
            parts = [c.slice(lo, n) for c in columns]
            yield pa.array([work(*(v.as_py() for v in row)) for row in zip(*parts, strict=True)], out)
        if not len(columns[0]):
            yield pa.array([], out)
