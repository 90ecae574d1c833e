"""Vectorised character n-grams and word hashes over whole batches of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_M = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
SPACE = 32


def _fold_table(letters_only: bool) -> np.ndarray:
    """Lower-cased ASCII; what separates words becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:33] = SPACE
    if letters_only:
        keep = np.zeros(256, bool)
        keep[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
        keep[128:] = True
        table[~keep] = SPACE
    return table


_FOLD = {flag: _fold_table(flag) for flag in (True, False)}


@dataclass
class WordView:
    """Folded bytes of a batch, a space before, between and after its texts, and where words begin and end."""

    folded: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray  # n + 1: index of each text's first word

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.starts


def view(raw: np.ndarray, offsets: np.ndarray, letters_only: bool) -> WordView:
    """Words are runs of letters and digits (``letters_only``) or of anything but white space; bytes above 127 count as
    letters and Latin-1 capitals are lower-cased."""
    n, data = len(offsets) - 1, raw.tobytes()
    cut = offsets.tolist()
    spread = np.frombuffer(b" " + b" ".join([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]) + b" ", np.uint8)
    at = offsets[:-1] + np.arange(n) + 1
    folded = _FOLD[letters_only][spread]
    capital = np.flatnonzero((spread[:-1] == 0xC3) & (spread[1:] >= 0x80) & (spread[1:] <= 0x9E) & (spread[1:] != 0x97)) + 1
    folded[capital] += 32
    inside = folded != SPACE
    edge = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    first = np.searchsorted(starts, np.append(at, len(folded)))
    return WordView(folded, inside, starts, ends, first)


def grams(v: WordView, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every place but the last n - 1, and whether it stays within a word and its two borders."""
    size = len(v.folded) - n + 1
    if size <= 0:
        return np.empty(0, np.uint32), np.empty(0, bool)
    wide = v.folded.astype(np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = h * _M + wide[k : k + size]
    h ^= h >> np.uint32(15)
    h *= _MIX
    valid = v.inside[1 : 1 + size].copy()
    for k in range(2, n - 1):
        valid &= v.inside[k : k + size]
    return h >> np.uint32(32 - bits), valid


def gram_counts(v: WordView, orders: tuple[int, ...]) -> np.ndarray:
    """How many n-grams of these orders each word has."""
    return sum(np.maximum(v.lengths + 3 - n, 0) for n in orders)


def word_hashes(v: WordView) -> np.ndarray:
    """A 32-bit hash of each word's bytes."""
    if not len(v.starts):
        return np.empty(0, np.uint32)
    longest = int(v.lengths.max())
    power = np.full(longest, _M, np.uint32)
    power[0] = 1
    power = np.multiply.accumulate(power)
    owner = np.cumsum(np.bincount(v.starts, minlength=len(v.folded)))  # 1-based word index at and after its start
    place = np.arange(len(v.folded)) - v.starts[np.maximum(owner - 1, 0)]
    value = np.where(v.inside, v.folded.astype(np.uint32) * power[np.where(v.inside, place, 0)], np.uint32(0))
    h = np.add.reduceat(value, v.starts, dtype=np.uint32)
    h ^= h >> np.uint32(15)
    return h * _MIX


def per_word(v: WordView, total: np.ndarray) -> np.ndarray:
    """Sums of ``total`` over each word's places alone, so that they do not depend on what stands around the word."""
    if not len(v.starts):
        return total[:0]
    return np.add.reduceat(total, np.column_stack([v.starts, v.ends]).ravel(), axis=0)[::2]


def word_sums(v: WordView, table: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """For each word, the sum of ``table`` over the buckets of its n-grams."""
    total = np.zeros(len(v.folded), np.float64)
    for n in orders:
        bucket, valid = grams(v, n, bits)
        at = np.flatnonzero(valid)
        total[at + 1] += table[bucket[at]]
    return per_word(v, total)
