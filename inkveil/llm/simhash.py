"""SimHash near-duplicates with pigeonring candidates.

Fingerprints of 64 bits are linked at ``distance`` or fewer differing bits. The fingerprint is cut into a ring of
SEGMENTS parts. If two fingerprints differ in d <= distance bits, then some part begins a chain in which, for every
length l, the first l parts differ in at most l * distance / SEGMENTS bits together (the pigeonring principle). With five
parts and distance two the chain's first two parts must be equal: they are the join key (about 26 bits, one key for each
part of the ring), and the longer prefixes of the chain are checked before the full Hamming distance.

For distance three a ring of four parts is used, whose chains have an equal first part and a second one that differs in
at most one bit: the key is both, once with each bit of the second part left out (about 31 bits, 64 keys).

Only distinct fingerprints are compared. Within a key, groups of more than MOST_IN_KEY fingerprints (masses of near
copies) would give pairs by the square of their number; they are linked exactly in another way, in proportion to their
number. Two fingerprints differ in at most two bits just when they share a point at most one bit away from either, so
each sends itself to its 65 points and is linked to the least fingerprint of each point. At distance three the point is
one bit away from one and two bits away from the other: each also goes to its points two bits away, and everything at a
point is linked to the least fingerprint that is at most one bit away from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.arrow_text import ranges, text_offsets
from inkveil.llm.components import min_labels
from inkveil.llm.minhash import shingle_hashes, signature_column, similar_links
from inkveil.llm.storage import join_classes, materialize

SEGMENTS = 5
DISTANCE = 2
MOST_IN_KEY = 48
SHINGLE_WORDS = 5
#: Jaccard similarity of five-word shingles from which on texts are near copies whatever their fingerprints.
SIMILARITY = 0.8


def _fingerprint(text: bytes, words: int) -> int:
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    count = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(packed), 8192):
        count += np.unpackbits(packed[lo : lo + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(packed), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The 64-bit SimHash of word shingles as a bigint (its bits, not its sign, matter)."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for lo, hi in ranges(texts):
            part = texts.slice(lo, hi - lo)
            offsets, data = text_offsets(part).tolist(), part.buffers()[2]
            view = memoryview(data) if data is not None else memoryview(b"")
            out += [_fingerprint(bytes(view[a:b]), words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return run(F.coalesce(text, F.lit("")))


def _widths(segments: int) -> list[int]:
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def _parts(value: Column, segments: int) -> list[Column]:
    """The ring's parts, as bits in place."""
    out, at = [], 0
    for width in _widths(segments):
        mask = ((1 << width) - 1) << at
        out.append(value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        at += width
    return out


def equal_prefix(segments: int, distance: int) -> int:
    """How many parts at the beginning of a pigeonring chain cannot differ."""
    return max(n for n in range(1, segments + 1) if n * distance < segments)


def _keys(value: Column, segments: int, distance: int) -> tuple[list[Column], int]:
    """The keys of a fingerprint as (part, mask, key), and how many parts of a chain they cover."""
    parts, widths, equal = _parts(value, segments), _widths(segments), equal_prefix(segments, distance)
    begin = [sum(widths[:i]) for i in range(segments)]
    keys = []
    for i in range(segments):
        key = parts[i]
        for k in range(1, equal):
            key = key.bitwiseOR(parts[(i + k) % segments])
        if equal > 1:
            keys.append(F.struct(F.lit(i).alias("part"), F.lit(-1).alias("mask"), key.alias("key")))
            continue
        j = (i + 1) % segments  # the next part may differ in one bit, which is left out
        for bit in range(begin[j], begin[j] + widths[j]):
            rest = ~(1 << bit) & ((1 << 64) - 1)
            masked = parts[j].bitwiseAND(F.lit(rest - (1 << 64) if rest >> 63 else rest))
            keys.append(F.struct(F.lit(i).alias("part"), F.lit(bit).alias("mask"), key.bitwiseOR(masked).alias("key")))
    return keys, equal


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint")


def _point_links(large: DataFrame, distance: int) -> DataFrame:
    """Links among masses of fingerprints, in proportion to their number."""
    ones = F.array(*(_bit(i) for i in range(64)))
    near = large.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), ones)).alias("flip"))
    point = near.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    if distance == 1:
        ring = near.where("flip <> 0").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).join(large.select(F.col("fp").alias("point")), "point")
        return ring.select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b"))
    members = point
    if distance == 3:
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.slice(ones, i + 2, 63 - i), lambda y: y.bitwiseOR(F.get(ones, i)))))
        far = large.select("fp", F.explode(pairs).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
        members = point.unionByName(far)
    least = point.groupBy("point").agg(F.min("fp").alias("a"))
    return members.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, segments: int | None = None, most: int = MOST_IN_KEY) -> DataFrame:
    """Links (a, b) whose connected components are those of "differs in at most ``distance`` bits".

    ``prints`` has distinct values in column ``fp``. ``distance`` is 3 at most: the way of large groups needs that.
    """
    segments = segments or (SEGMENTS if distance < 3 else 4)
    if not 1 <= distance <= 3 or distance >= segments or (equal_prefix(segments, distance) == 1 and 2 * distance >= 2 * segments):
        raise ValueError("distance must be 1, 2 or 3, and less than the number of segments")
    keys, equal = _keys(F.col("fp"), segments, distance)
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.mask", "k.key", "fp")
    on = ["part", "mask", "key"]
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy(*on))).where("n > 1")  # shuffled once, for both ways
    small = sized.where(F.col("n") <= most).groupBy(*on).agg(F.collect_list("fp").alias("fps"))
    left = small.select("part", "mask", F.col("fps").alias("all"), F.explode("fps").alias("a"))
    begin = [sum(_widths(segments)[:i]) for i in range(segments)]

    def linked(b: Column) -> Column:
        """Along the chain that the key begins, then in all bits; a pair under several masks counts under one."""
        diff = F.col("a").bitwiseXOR(b)
        pieces = [F.bit_count(p) for p in _parts(diff, segments)]
        chain = F.lit(False)
        for i in range(segments):
            holds, total = F.col("part") == i, F.lit(0)
            for n in range(1, segments + 1):
                total = total + pieces[(i + n - 1) % segments]
                if n > equal:
                    holds = holds & (total <= n * distance // segments)
            if equal == 1:
                j = (i + 1) % segments
                holds = holds & ((pieces[j] > 0) | (F.col("mask") == begin[j]))
            chain = chain | holds
        return (b > F.col("a")) & (F.bit_count(diff) <= distance) & chain

    verified = left.select("a", F.explode(F.filter("all", linked)).alias("b"))
    large = sized.where(F.col("n") > most).select("fp").distinct()
    return verified.unionByName(_point_links(large, distance)).distinct()


def _grouped(rows: DataFrame, words: int, distance: int, segments: int | None, most: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """From rows (id, text, and others): the rows without their texts but with fp; and a row for each distinct fp with its
    number of rows ``n``, its least ``first`` (id, row) and the ``label`` of its group."""
    if similarity is None and words == SHINGLE_WORDS:
        similarity = SIMILARITY
    columns = [*(c for c in rows.columns if c != "text"), fingerprint_column(F.col("text"), words).alias("fp")]
    if similarity:
        columns += [F.xxhash64("text").alias("at"), signature_column(F.col("text"), words).alias("s")]
    prints = materialize(rows.select(*columns))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *(["row"] if "row" in rows.columns else []))))
    classes = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")))
    links = link_fingerprints(classes.select("fp"), distance, segments, most)
    if similarity:
        links = similar_links(prints.select("fp", "at", "s.*"), rows, "text", words, similarity, links)
    labels = min_labels(links).withColumnRenamed("node", "fp")
    return prints, materialize(classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE, segments: int | None = None, most: int = MOST_IN_KEY, similarity: float | None = None
) -> DataFrame:
    """One row per document: id, fp (bigint), component_id (the smallest id of its group of linked fingerprints).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get a row; null ids get
    the group of their fingerprint and never name one, so a group of null ids alone has a null component_id. An empty
    table gives no rows. Other columns of ``docs`` are not read.

    Texts whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked too, however many bits their
    fingerprints differ in. It is SIMILARITY for shingles of SHINGLE_WORDS words when not given; for others, and with
    zero, fingerprints alone decide.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, classes = _grouped(rows, words, distance, segments, most, similarity)
    groups = classes.groupBy("label").agg(F.min("first.id").alias("component_id"), F.count("*").alias("size"))
    n_prints, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = join_classes(classes.select("fp", "n", "label"), groups, "label", "size", n_prints).select("fp", "n", "component_id")
    return join_classes(prints.select("id", "fp"), named, "fp", "n", n_rows).select(F.col("id").alias(id_col), "fp", "component_id")


def first_of_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE, segments: int | None = None, most: int = MOST_IN_KEY, similarity: float | None = None
) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group: of each group, one row with the smallest id.

    Rows are told apart by a number of their own, not by their ids: different texts with one id are judged each by itself,
    and of equal rows one stays. Rows without an id stay, all of them. Texts are written once and not shuffled: the numbers of the
    rows that stay go to them as bitmaps.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    prints, classes = _grouped(rows, words, distance, segments, most, similarity)
    firsts = classes.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")).where("__row IS NOT NULL")
    stay = firsts.unionByName(prints.where("id IS NULL").select(F.col("row").alias("__row")))
    return _with_rows(numbered, stay, "__row").select(*docs.columns)


def _with_rows(numbered: DataFrame, stay: DataFrame, row: str) -> DataFrame:
    """The rows of ``numbered`` whose number is among those of ``stay``, by bitmaps of 32768 numbers: as numbers run on within
    a partition, all of them take little more than a bit for each row, and are broadcast."""
    bits = stay.groupBy(F.bitmap_bucket_number(row).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("__bits"))
    joined = numbered.withColumn("__bucket", F.bitmap_bucket_number(row)).join(F.broadcast(bits), "__bucket")
    place = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.get(F.array(*(byte.bitwiseAND(F.lit(1 << k)) for k in range(8))), (place % 8).cast("int")) != 0).drop("__bucket", "__bits")
