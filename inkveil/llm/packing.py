"""Best-fit packing of token sequences.

Documents are tokenised and packed in one pass without a shuffle: each task keeps a fixed number of open bins in a
bitset keyed by free space, puts a piece where the least space is left over, and closes the fullest bin when one too
many is open. A task's memory does not depend on how much it reads; rows leave as soon as they are placed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkveil.llm.arrow_text import give_back, slices
from inkveil.llm.bpe import SpaceSegments, kept_in_worker, read_vocabulary

CAPACITY = 1024
OPEN_BINS = 8192
END_ID = 2
GIVEN_IDS = 1 << 18  # of pieces that leave a worker at once


class SmallSegments(SpaceSegments):
    """With a memo and batches that leave a worker room beside an executor that earlier stages have filled. It goes when
    its task ends: workers live on through the stages that follow, which would have to do without its memory."""

    memo_bytes = 16 << 20
    batch_bytes = 1 << 18
    stays = False


class OpenBins:
    """Bounded-space online best fit.

    ``bits`` has bit f set when some open bin has f free places; ``at[f]`` lists those bins. The best bin for a piece of
    n is then the lowest set bit at or above n, and the fullest bin of all is the lowest set bit.
    """

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_id = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, n: int) -> tuple[int, int]:
        """The bin that gets a piece of ``n`` (1 to capacity) and the place in it where the piece starts."""
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - n
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.at[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    segments: type[SpaceSegments] = SpaceSegments,
) -> DataFrame:
    """One row per piece: id, piece, start, length, tokens (little-endian unsigned 32-bit), sequence_id, offset.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library. A document is its ids and ``end_id``;
    one longer than ``capacity`` is cut into pieces of ``capacity`` of which the first may be shorter. Null and empty
    texts are a single ``end_id``. Repeated rows are packed as often as they come; null ids stay null; an empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    config = read_vocabulary(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start bigint, length bigint, tokens binary, sequence_id bigint, offset bigint"
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(segments, config) if segments.stays else segments(config)
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text_col):
            ids, packed = batch.column(id_col), encoder.encode(batch.column(text_col))
            row, piece, start, length = [], [], [], []
            for i, raw in enumerate(packed):
                n, at, k = len(raw) // 4 + 1, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    at, k = at + size, k + 1
            sequence, offset = [0] * len(row), [0] * len(row)
            for j in np.argsort(-np.array(length), kind="stable").tolist():  # large pieces first within what is at hand
                sequence[j], offset[j] = bins.place(length[j])
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(length) // GIVEN_IDS)) + 1).tolist(), len(row)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                tokens = [packed[i][at * 4 : (at + size) * 4] for i, at, size in zip(row[lo:hi], start[lo:hi], length[lo:hi], strict=True)]
                tokens = [t if len(t) == 4 * size else t + end for t, size in zip(tokens, length[lo:hi], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[lo:hi], pa.int64())), pa.array(piece[lo:hi], pa.int32()), pa.array(start[lo:hi], pa.int64()), pa.array(length[lo:hi], pa.int64()),
                     pa.array(tokens, pa.binary()), pa.array([base + s for s in sequence[lo:hi]], pa.int64()), pa.array(offset[lo:hi], pa.int64())],
                    names=[id_col, "piece", "start", "length", "tokens", "sequence_id", "offset"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(batches)
        if not segments.stays:
            give_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
