"""Pairs of texts whose shingle sets have a Jaccard similarity of a threshold or more.

A text's distinct shingles give a signature of BANDS x ROWS minima under as many hash functions. Texts that agree in a
whole band are candidates: at a similarity of 0.8 all bands miss a pair with a chance of 3e-6. A candidate is dropped when
its signatures agree in a share SLACK below the threshold (more than four standard deviations); what is left is decided
by the exact similarity of the two texts' shingle sets.

Candidates are taken in two turns, so that masses of near copies do not give all their pairs. First each text of a band
meets the least one. Then, in bands that still hold more than one component, texts of different components meet, in blocks
of BLOCK: signatures name the texts that may have a partner, and of those the sets themselves are compared within the
blocks. A pair is looked at in the first band that it shares, and only once its ends are not yet connected in the block;
what leaves a block is never more than the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.arrow_text import ranges, text_offsets
from inkveil.llm.components import min_labels
from inkveil.llm.storage import materialize

BANDS, ROWS = 32, 5
SLACK = 0.15
BLOCK = 256
BROADCAST_ROWS = 1_000_000
_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """A hash for every shingle of the text in order; a shorter text is one shingle, an empty one has none."""
    parts = text.lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    begin = np.cumsum(sizes) - sizes
    end = (begin + sizes - 1)[words - 1 :]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(begin.tolist(), end.tolist(), strict=False)]


def _signature(distinct: np.ndarray) -> bytes:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(distinct), 1024):
        np.minimum(least, (distinct[lo : lo + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return ((least * _MIX) >> np.uint64(48)).astype("<u2").tobytes()


def _each(texts: pa.Array) -> list[bytes]:
    offsets, data = text_offsets(texts).tolist(), texts.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def signature_column(text: Column, words: int) -> Column:
    """(shingles: a hash of the set of shingles, null if it is empty; sig: the signature)."""

    @F.arrow_udf("struct<shingles:bigint,sig:binary>")
    def run(texts: pa.Array) -> pa.Array:
        name, sig = [], []
        for lo, hi in ranges(texts):
            for one in _each(texts.slice(lo, hi - lo)):
                distinct = np.unique(np.array(shingle_hashes(one, words), np.uint64))
                name.append(int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 42)).view(np.int64)) if len(distinct) else None)
                sig.append(_signature(distinct) if len(distinct) else None)
        return pa.StructArray.from_arrays([pa.array(name, pa.int64()), pa.array(sig, pa.binary())], names=["shingles", "sig"])

    return run(F.coalesce(text, F.lit("")))


def _agree(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        table = lambda x: np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(len(x), -1)
        return pa.array((table(left) == table(right)).mean(axis=1) if len(left) else np.empty(0))

    return run(a, b)


def jaccard(a: Column, b: Column, words: int) -> Column:
    """The exact similarity of two texts' shingle sets."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            one, two = (set(shingle_hashes(t.as_py().encode(), words)) for t in (x, y))
            out.append(len(one & two) / max(1, len(one | two)))
        return pa.array(out, pa.float64())

    return run(a, b)


def _apart(label: np.ndarray, block: np.ndarray, sig: np.ndarray, nth: int, least: float, i: int) -> np.ndarray:
    """Rows after row ``i`` of another label (and of the other block, where there are two) whose signatures agree with its
    own in a share ``least``, and in no whole band before the ``nth``."""
    other = np.flatnonzero((label[i + 1 :] != label[i]) & ((block[i + 1 :] != block[i]) | (block[0] == block[-1]))) + i + 1
    if not len(other):
        return other
    same = sig[other] == sig[i]
    earlier = same[:, : nth * ROWS].reshape(len(other), nth, ROWS).all(axis=2).any(axis=1)
    return other[(same.mean(axis=1) >= least) & ~earlier]


def _rows(group: pa.ListScalar) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(group.as_py(), key=lambda r: (r["block"], r["shingles"]))
    return rows, np.array([r["label"] for r in rows]), np.array([r["block"] for r in rows]), np.frombuffer(b"".join(r["sig"] for r in rows), "<u2").reshape(len(rows), -1)


def _candidates(groups: Column, nth: Column, least: float) -> Column:
    """The texts of a group of (block, label, shingles, sig) rows that may have a partner in it."""

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array, bands: pa.Array) -> pa.Array:
        out = []
        for group, band in zip(lists, bands.to_pylist(), strict=True):
            rows, label, block, sig = _rows(group)
            wanted: set[int] = set()
            for i in range(len(rows)):
                near = _apart(label, block, sig, band, least, i).tolist()
                wanted.update(near, [i] if near else [])
            out.append([rows[i]["shingles"] for i in wanted])
        return pa.array(out, pa.list_(pa.int64()))

    return run(groups, nth)


def _forest(groups: Column, nth: Column, least: float, similarity: float) -> Column:
    """Links of fingerprints that connect the similar texts of a group of (block, label, shingles, sig, fp, set) rows."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def run(lists: pa.Array, bands: pa.Array) -> pa.Array:
        out = []
        for group, band in zip(lists, bands.to_pylist(), strict=True):
            rows, label, block, sig = _rows(group)
            sets = [np.frombuffer(r["set"], "<u8") for r in rows]
            root = {x: x for x in label.tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = []
            for i in range(len(rows)):
                for j in _apart(label, block, sig, band, least, i).tolist():
                    x, y = find(rows[i]["label"]), find(rows[j]["label"])
                    if x == y or similarity * max(len(sets[i]), len(sets[j])) > min(len(sets[i]), len(sets[j])):
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                        root[x] = y
                        links.append({"a": min(rows[i]["fp"], rows[j]["fp"]), "b": max(rows[i]["fp"], rows[j]["fp"])})
            out.append(links)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run(groups, nth)


def shingle_set_column(text: Column, words: int) -> Column:
    """The sorted hashes of a text's distinct shingles, eight bytes each."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(np.array(shingle_hashes(t, words), "<u8")).tobytes() for lo, hi in ranges(texts) for t in _each(texts.slice(lo, hi - lo))], pa.binary())

    return run(F.coalesce(text, F.lit("")))


def _with_texts(wanted: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(shingles, fp, text) of the ``wanted`` shingle sets (distinct)."""
    places = materialize(sets.select("shingles", "fp", "at").join(wanted, "shingles"))
    ats = places.select("at").distinct()
    if ats.count() <= BROADCAST_ROWS:  # the texts of all other documents are then not shuffled
        ats = F.broadcast(ats)
    texts = docs.select(F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text")).join(ats, "at", "left_semi").dropDuplicates(["at"])
    return places.join(texts, "at").select("shingles", "fp", "text")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of the fingerprints of ``pairs`` (a, b, as hashes of shingle sets) that are similar indeed."""
    wanted = pairs.select(F.col("a").alias("shingles")).unionByName(pairs.select(F.col("b").alias("shingles"))).distinct()
    named = materialize(_with_texts(wanted, sets, docs, text_col))
    side = lambda c: named.select(F.col("shingles").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    similar = both.withColumn("__j", jaccard(F.col("text_a"), F.col("text_b"), words)).where(F.col("__j") >= similarity)
    return similar.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).where("a <> b").distinct()


def _in_blocks(rows: DataFrame, *carry: str) -> DataFrame:
    """(nth, all): the rows (band, nth, n, label, shingles, sig) of each band in pairs of blocks of about BLOCK rows, none
    of one label alone."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("shingles"), blocks).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grouped = spread.groupBy("band", "nth", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    gathered = grouped.agg(F.collect_list(F.struct("block", "label", "shingles", "sig", *carry)).alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return gathered.where("lo <> hi").select("band", "nth", "all")


def similar_links(prints: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float, known: DataFrame) -> DataFrame:
    """``known`` links (a, b) of fingerprints, and such as connect texts of ``similarity`` or more that they leave apart.

    ``prints`` has fp, at (xxhash64 of the text), shingles and sig of every document.
    """
    full = prints.where("shingles IS NOT NULL").groupBy("shingles").agg(F.collect_set("fp").alias("fps"), F.min("at").alias("at"), F.min("sig").alias("sig"))
    sets = materialize(full.select("shingles", F.array_min("fps").alias("fp"), "fps", "at", "sig"))
    equal = sets.where(F.size("fps") > 1).select(F.col("fp").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)))
    banded = sets.select("shingles", F.posexplode(keys).alias("nth", "band"))
    whole = Window.partitionBy("band")
    members = materialize(banded.withColumns({"n": F.count("*").over(whole), "hub": F.min("shingles").over(whole)}).where("n > 1"))

    least = similarity - SLACK
    hubs = members.where("hub <> shingles").select(F.col("hub").alias("a"), F.col("shingles").alias("b")).distinct()
    side = lambda c: sets.select(F.col("shingles").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = hubs.join(side("a"), "a").join(side("b"), "b").withColumn("__s", _agree(F.col("sig_a"), F.col("sig_b"))).where(F.col("__s") >= least)
    first = _verified(materialize(near.select("a", "b")), sets, docs, text_col, words, similarity)
    links = materialize(known.unionByName(equal).unionByName(first).distinct())

    labels = min_labels(links)
    named = sets.select("shingles", "fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("shingles", "fp", F.coalesce("label", "fp").alias("label"))
    labelled = members.drop("hub").join(named, "shingles")
    open_bands = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    left = materialize(labelled.join(open_bands, "band"))
    groups = _in_blocks(left.join(sets.select("shingles", "sig"), "shingles"))
    wanted = materialize(groups.select("band", F.explode(_candidates(F.col("all"), F.col("nth"), least)).alias("shingles")).distinct())
    if wanted.isEmpty():
        return links
    texts = _with_texts(wanted.select("shingles").distinct(), sets, docs, text_col).select("shingles", shingle_set_column(F.col("text"), words).alias("set"))
    some = left.drop("n").join(wanted, ["band", "shingles"]).join(wanted.groupBy("band").agg(F.count("*").alias("n")), "band")
    pairs = _in_blocks(some.join(sets.select("shingles", "sig"), "shingles").join(texts, "shingles"), "fp", "set")
    second = pairs.select(F.explode(_forest(F.col("all"), F.col("nth"), least, similarity)).alias("p")).select("p.a", "p.b").distinct()
    return links.unionByName(second)
