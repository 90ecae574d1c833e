"""Language proportions of texts by expectation-maximisation over word likelihoods.

A language is a table of smoothed log-probabilities of hashed character n-grams. The words of a text are drawn from a
mixture of languages whose proportions EM estimates; of the nested sets of its most frequent languages, the text gets
the one with the highest likelihood less half a log of its words for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import ngrams
from inkveil.llm.arrow_text import ranges, text_bytes
from inkveil.llm.sampling import pick_ids, sample_texts
from inkveil.llm.storage import id_bucket

ORDERS = (3, 4)
BITS = 16
ROUNDS = 4
SAMPLE_PER_LANGUAGE = 500  # bound on the rows that a language's table is counted over
SAMPLE_BYTES = 2 << 20  # bound on their texts together
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    names: list[str]
    tables: np.ndarray  # language x bucket


def _slices(texts: pa.Array):
    for lo, hi in ranges(texts):
        yield ngrams.view(*text_bytes(texts.slice(lo, hi - lo)), True)


def fit(texts: list[str], names: list[str]) -> Languages:
    """Count n-grams for each language and smooth them. No texts: no languages."""
    known = sorted(set(names))
    tables = np.zeros((len(known), 1 << BITS), np.float32)
    for k, name in enumerate(known):
        counts = np.zeros(1 << BITS)
        for v in _slices(pa.array([t for t, n in zip(texts, names, strict=True) if n == name], pa.string())):
            for n in ORDERS:
                bucket, valid = ngrams.grams(v, n, BITS)
                counts += np.bincount(bucket[valid], minlength=1 << BITS)
        tables[k] = np.log((counts + 0.2) / (counts.sum() + 0.2 * len(counts)))
    return Languages(known, tables)


def _word_scores(v: ngrams.WordView, tables: np.ndarray) -> np.ndarray:
    total = np.zeros((len(v.folded), len(tables)), np.float32)
    for n in ORDERS:
        bucket, valid = ngrams.grams(v, n, BITS)
        at = np.flatnonzero(valid)
        total[at + 1] += tables.T[bucket[at]]
    return ngrams.per_word(v, total)


def _expect(scores: np.ndarray, at: np.ndarray, owner: np.ndarray, allowed: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, from words' scores; ``at`` has texts' first words, none is empty."""
    words = np.diff(np.append(at, len(scores)))[:, None]
    fit_ = np.zeros(len(at))
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            w = scores + np.log(np.where(allowed, share, 0.0)).astype(np.float32)[owner]
        top = w.max(axis=1)
        np.exp(w - top[:, None], out=w)
        s = w.sum(axis=1)
        w /= s[:, None]
        share = np.add.reduceat(w, at, axis=0, dtype=np.float64) / words
        share = np.where(allowed, np.maximum(share, 1e-6), 0.0)
        share /= share.sum(axis=1, keepdims=True)
        fit_ = np.add.reduceat(top + np.log(s), at, dtype=np.float64)
    return share, fit_


def proportions(model: Languages, v: ngrams.WordView) -> np.ndarray:
    """A row of language proportions for each text; zeros where it has no word, or where no language is known."""
    n, k = len(v.first_word) - 1, len(model.names)
    out = np.zeros((n, k))
    full = np.flatnonzero(np.diff(v.first_word) > 0)
    if not len(full) or not k:
        return out
    scores, at = _word_scores(v, model.tables), v.first_word[full]
    words = np.diff(np.append(at, len(scores)))
    owner, cost = np.repeat(np.arange(len(full)), words), 0.5 * np.log(words + 1.0)
    share, fit_ = _expect(scores, at, owner, np.ones((len(full), k), bool), np.full((len(full), k), 1 / k), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, value = share, fit_ - k * cost
    single = np.add.reduceat(scores[np.arange(len(scores)), share.argmax(axis=1)[owner]], at, dtype=np.float64) - cost
    better = single >= value
    best = np.where(better[:, None], (rank == 0).astype(float), best)
    value = np.maximum(value, single)
    rest = np.flatnonzero(~better)
    for size in range(2, k):  # texts that one language does not explain
        if not len(rest):
            break
        pick = np.concatenate([np.arange(a, a + m) for a, m in zip(at[rest], words[rest], strict=True)])
        starts = np.append(0, np.cumsum(words[rest]))[:-1]
        allowed = rank[rest] < size
        tried, likely = _expect(scores[pick], starts, np.repeat(np.arange(len(rest)), words[rest]), allowed, share[rest], ROUNDS)
        likely -= size * cost[rest]
        wins = likely > value[rest]
        best[rest[wins]], value[rest[wins]] = tried[wins], likely[wins]
    out[full] = best
    return out


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Tables from at most SAMPLE_PER_LANGUAGE rows and SAMPLE_BYTES of each language outside the held-out fold
    (``crc32(id as text) mod 4 = 2``), whatever their lengths; a hash of the id picks them."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (id_bucket(id_col, FOLDS) != HELD_OUT))
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    got = sample_texts(rows, pick_ids(rows.select("id", "label"), SAMPLE_PER_LANGUAGE), SAMPLE_BYTES)
    return fit([t for t, _ in got], [n for _, n in got])


def identify_languages(docs: DataFrame, model: Languages, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang_pred, score (its proportion), languages and proportions of the chosen set.

    Null texts and texts without a letter get ``und``, score 0 and no languages, as does everything if no language was
    learned. Nothing but the text is looked at; repeated rows and null ids are treated like any other row.
    """

    @F.arrow_udf("lang_pred string, score double, languages array<string>, proportions array<double>")
    def guess(texts: pa.Array) -> pa.Array:
        rows = []
        for v in _slices(texts):
            for p in proportions(model, v):
                order = [j for j in np.argsort(-p, kind="stable").tolist() if p[j] > 1e-5]
                if order:
                    rows.append({"lang_pred": model.names[order[0]], "score": float(min(1.0, p[order[0]])), "languages": [model.names[j] for j in order], "proportions": [float(p[j]) for j in order]})
                else:
                    rows.append({"lang_pred": UNKNOWN, "score": 0.0, "languages": [], "proportions": []})
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, guess(F.when(text.rlike(r"\p{L}"), text).otherwise(F.lit(""))))
