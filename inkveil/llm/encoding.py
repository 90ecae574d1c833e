"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text where its content says so, so that passages which documents share fall
into the same chunks wherever they stand. A worker encodes a chunk once and keeps it in a memo of bounded bytes, from
task to task; the words that a
cut went through are encoded again from the last white space before the cut to the next one after it (over as many
chunks as that takes), where both sides agree exactly with the encoding of the whole text, since the vocabulary's
pre-tokeniser drops white space and never joins across it. Within a new chunk, known words come from a second memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.arrow_text import slices, text_bytes
from inkveil.llm.bpe import Memo, Words, kept_in_worker, read_vocabulary

CHUNK_BITS = 9  # a cut every 2**9 bytes on average
WINDOW = 8
CHUNK_MEMO_BYTES = 48 << 20
_WHITE = b" \t\n\r\x0b\x0c"


def cut_points(raw: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes asks for a cut."""
    if len(raw) < WINDOW:
        return np.empty(0, np.int64)
    wide, n = raw.astype(np.uint32), len(raw) - WINDOW + 1
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h = h * np.uint32(0x01000193) + wide[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + WINDOW


class ChunkEncoder:
    """Encodes texts by chunks; ``encode`` equals encoding each whole text."""

    def __init__(self, config: str, bits: int = CHUNK_BITS):
        self.words, self.bits = Words(config), bits
        self.memo = Memo(CHUNK_MEMO_BYTES)  # (head, ids, tail) of a chunk, or None if it is part of a word

    def _parts(self, chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """The word that may go on from before, the whole words, and the word that may go on after; None if there is no cut."""
        words = chunk.split()
        lead, trail = chunk[0] in _WHITE, chunk[-1] in _WHITE
        if not lead and not trail and len(words) == 1:
            return None
        head = b"" if lead else words.pop(0)
        tail = b"" if trail or not words else words.pop()
        return head, words, tail

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        documents: list[list[bytes]] = []
        points = cut_points(raw, self.bits)
        lows, highs = np.searchsorted(points, offsets[:-1] + WINDOW), np.searchsorted(points, offsets[1:])
        for a, b, lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lows.tolist(), highs.tolist(), strict=True):
            cuts = [a, *points[lo:hi].tolist(), b]  # no window reaches into another text
            documents.append([data[p:q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)] if b > a else [])
        fresh = {c: self._parts(c) for c in self.memo.missing({c for chunks in documents for c in chunks})}
        wanted: set[bytes] = set()
        for parts in fresh.values():
            if parts:
                wanted.update(parts[1])
        joins: list[list[bytes | tuple[bytes, ...]]] = []
        for chunks in documents:  # a text as a list of chunks, and of words which cuts went through
            line: list[bytes | tuple[bytes, ...]] = []
            open_word: list[bytes] = []
            for c in chunks:
                parts = fresh[c] if c in fresh else self.memo[c]
                if parts is None:
                    open_word.append(c)
                    continue
                word = b"".join(open_word) + parts[0]
                if word:
                    line.append((word,))
                    wanted.add(word)
                line.append(c)
                open_word = [parts[2]] if parts[2] else []
            if open_word:
                line.append((word := b"".join(open_word),))
                wanted.add(word)
            joins.append(line)
        self.words.learn(wanted)
        known = self.words.memo
        self.memo.put((c, parts and (parts[0], b"".join([known[w] for w in parts[1]]), parts[2])) for c, parts in fresh.items())
        return [b"".join([known[x[0]] if type(x) is tuple else self.memo[x][1] for x in line]) for line in joins]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit), decoded (the tokens of the ids, as text).

    ``vocabulary`` is the path of a BPE file with word ends of the tokenizers library. Null and empty texts have no ids
    and decode to the empty text; repeated rows and null ids are kept; an empty table gives no rows.
    """
    config = read_vocabulary(vocabulary)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(ChunkEncoder, config)
        for batch in slices(batches, text_col):
            ids = encoder.encode(*text_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([encoder.words.decode(x) for x in ids], pa.binary()).cast(pa.string())],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
