"""Subword-bag text classifiers: hashed word and character n-gram vectors, averaged, into a linear softmax.

Vectors and softmax are trained jointly by numpy gradient descent on a bounded sample of labelled rows. Since averaging
and the softmax's logits are linear, a trained model is one number per bucket (its vector times the difference of the
two class vectors) and a bias: that is what tasks receive, a table of a fixed 2**BITS floats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import ngrams
from inkveil.llm.arrow_text import give_back, ranges, text_bytes
from inkveil.llm.sampling import pick_ids, sample_texts
from inkveil.llm.storage import id_bucket

BITS = 17
DIMENSIONS = 8
ORDERS = (3, 4, 5)
#: Of texts that are scored at once: the arrays over their places take some sixty times as much.
SCORE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """How texts become bags, and how a model is fitted."""

    letters_only: bool = True  # words of letters and digits, or of all that is not white space
    window: int = 24  # words of an averaged window, an even number; 0: one average over the whole text
    repeats: bool = False  # a word that equals the one before it: a feature of its own, or else no part of the bag
    floor: int = 0  # an average is over at least so many features
    epochs: int = 8
    rate: float = 0.5
    sample_per_class: int = 2000  # bound on the labelled rows that a model is fitted on
    sample_bytes: int = 4 << 20  # bound on each class's texts together


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    bias: float
    settings: Settings


def _extra(v: ngrams.WordView, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket for each word (the word itself, or the repeat feature), and whether the word is in the bag."""
    h = ngrams.word_hashes(v)
    bucket, again = h >> np.uint32(32 - BITS), np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    first = v.first_word[:-1]
    again[first[first < len(h)]] = False  # a text's first word repeats nothing
    if settings.repeats:
        bucket[again] = 1
        return bucket, np.ones(len(h), bool)
    return bucket, ~again


def _blocks(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half windows: their first and past-the-last words, and each text's first one (n + 1). Without a window, whole texts."""
    if not window:
        return first[:-1], first[1:], np.arange(len(first))
    step = max(1, window // 2)
    each = np.maximum(1, -(-np.diff(first) // step))
    base = np.append(0, np.cumsum(each))
    lo = np.repeat(first[:-1], each) + (np.arange(base[-1]) - np.repeat(base[:-1], each)) * step
    return lo, np.minimum(lo + step, np.repeat(first[1:], each)), base


def window_bounds(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last words of half-overlapping windows: every two half windows in a row, or a text's only one."""
    lo, hi, base = _blocks(first, window)
    return (lo, hi) if not window else (lo[_windows(base)], hi[np.minimum(_windows(base) + 1, _last(base))])


def _windows(base: np.ndarray) -> np.ndarray:
    """The half window with which each window begins: any but a text's last, or its only one."""
    begins = np.ones(base[-1], bool)
    begins[base[1:][np.diff(base) > 1] - 1] = False
    return np.flatnonzero(begins)


def _last(base: np.ndarray) -> np.ndarray:
    """For each window, the last half window of its text."""
    return np.repeat(base[1:] - 1, np.maximum(1, np.diff(base) - 1))


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values``; each depends on its own values alone."""
    out, full = np.zeros(len(lo), np.float64), hi > lo
    if full.any():
        out[full] = np.add.reduceat(np.append(values, 0), np.column_stack([lo[full], hi[full]]).ravel())[::2]
    return out


def logits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The logit of each text: of its highest window, or of its whole bag. It does not depend on the other texts."""
    s = model.settings
    v = ngrams.view(raw, offsets, s.letters_only)
    sums, counts = ngrams.word_sums(v, model.table, ORDERS, BITS), ngrams.gram_counts(v, ORDERS) + 1
    if len(sums):
        bucket, kept = _extra(v, s)
        sums, counts = np.where(kept, sums + model.table[bucket], 0.0), np.where(kept, counts, 0)
    lo, hi, base = _blocks(v.first_word, s.window)
    total, places = _sums(sums, lo, hi), _sums(counts, lo, hi)
    if s.window:
        begin, last = _windows(base), _last(base)
        both = begin < last
        total = total[begin] + np.where(both, total[np.minimum(begin + 1, last)], 0.0)
        places = places[begin] + np.where(both, places[np.minimum(begin + 1, last)], 0.0)
        base = np.append(0, np.cumsum(np.maximum(1, np.diff(base) - 1)))
    mean = total / np.maximum(max(1, s.floor), places)
    return np.maximum.reduceat(mean, base[:-1]) + model.bias if len(mean) else mean


def probabilities(model: Model, texts: pa.Array) -> pa.Array:
    """A probability for each text, taken in slices of bounded bytes."""
    parts = [logits(model, *text_bytes(texts.slice(lo, hi - lo))) for lo, hi in ranges(texts, SCORE_BYTES)]
    z = np.concatenate(parts) if parts else np.empty(0)
    return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())


def score_column(model: Model, text: Column) -> Column:
    """:func:`probabilities` as an Arrow function."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return probabilities(model, texts)

    return score(F.coalesce(text, F.lit("")))


def fit(texts: list[str], labels: list[int], settings: Settings, seed: int = 7) -> Model:
    """Train on the driver; cost and memory are bounded by the sample's bound. Ends with no rows: a constant model."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=int)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = np.zeros((DIMENSIONS, 2), np.float32)
    out[:, 0], out[:, 1] = -0.5, 0.5
    bias = np.zeros(2, np.float32)
    seen = np.full(1 << BITS, 1e-6, np.float32)
    seen_out, seen_bias = np.full_like(out, 1e-3), np.full_like(bias, 1e-3)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        v = ngrams.view(data, np.array([0, len(data)]), settings.letters_only)
        extra, kept = _extra(v, settings)
        bucket, owner = [extra[kept].astype(np.int64)], [np.flatnonzero(kept)]
        place = np.cumsum(np.bincount(v.starts, minlength=len(v.folded))) - 1
        for n in ORDERS:
            b, valid = ngrams.grams(v, n, BITS)
            at = np.flatnonzero(valid)
            at = at[kept[place[at + 1]]]
            bucket.append(b[at].astype(np.int64)), owner.append(place[at + 1])
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        per_word = np.bincount(owner_all, minlength=len(v.starts)) if len(owner_all) else np.zeros(0, int)
        bags.append((np.concatenate(bucket)[order].astype(np.int32), np.append(0, np.cumsum(per_word)), *window_bounds(np.array([0, len(v.starts)]), settings.window)))
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        for i in rng.permutation(len(bags)):
            bucket, at, lo, hi = bags[i]
            if not len(bucket):
                continue
            if len(lo) > 1 and epoch:
                running = np.zeros((len(bucket) + 1, DIMENSIONS), np.float32)
                np.cumsum(vectors[bucket], axis=0, out=running[1:])
                a, b = at[lo], at[hi]
                means = (running[b] - running[a]) / np.maximum(max(1, settings.floor), b - a)[:, None]
                best = int(np.argmax(means @ (out[:, 1] - out[:, 0])))
                bucket = bucket[a[best] : b[best]]
            unique, count = np.unique(bucket, return_counts=True)
            weight = (count / max(len(bucket), settings.floor)).astype(np.float32)
            mean = weight @ vectors[unique]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            grad_out = np.outer(mean, p)
            seen_out += grad_out**2
            seen_bias += p**2
            out -= rate * 0.2 * grad_out / np.sqrt(seen_out)
            bias -= rate * 0.2 * p / np.sqrt(seen_bias)
            step = weight[:, None] * back
            seen[unique] += (step**2).mean(axis=1)
            vectors[unique] -= rate * step / np.sqrt(seen[unique])[:, None]
    direction = out[:, 1] - out[:, 0]
    never = seen < 2e-6  # a bucket that no sample row touched says nothing
    table = (vectors @ direction).astype(np.float32)
    table[never] = 0
    return Model(table, float(bias[1] - bias[0]), settings)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, modulus: int, held: int, id_col: str, text_col: str):
    """Texts and labels of at most ``sample_per_class`` rows and ``sample_bytes`` of each class outside the held-out fold,
    and the number of labelled ids of each class outside it."""
    learn = F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (id_bucket(id_col, modulus) != held)
    known = labels.where(learn).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = sample_texts(rows, pick_ids(known, settings.sample_per_class), settings.sample_bytes)
    return [t for t, _ in got], [y for _, y in got], share


def fit_labelled(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, modulus: int, held: int, id_col: str, text_col: str) -> Model:
    """A model of ``label``, its bias set to the share of the classes among all labelled rows of the learning folds.
    Without rows of both classes the model is the constant share of class 1 (one half without any)."""
    texts, ys, share = labelled_sample(docs, labels, label, settings, modulus, held, id_col, text_col)
    n0, n1 = ys.count(0), ys.count(1)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if n0 == n1 else (40.0 if n1 else -40.0), settings)
    model = fit(texts, ys, settings)
    give_back()  # the bags of all texts are some 100 MB that the driver would keep
    shift = np.log(share[1] / share[0]) - np.log(n1 / n0)
    return Model(model.table, model.bias + float(shift), settings)
