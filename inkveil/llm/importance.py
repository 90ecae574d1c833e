"""Importance resampling towards a target distribution.

Every text becomes an array of hashed feature buckets by higher-order functions. Corpus and target are counted by bucket,
where only a task's totals of the fixed number of buckets are shuffled; a document's weight is then the sum of the literal
gain array over its buckets, without exploding it. Gumbel noise from a hash of the id turns the highest scores into a
draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.storage import materialize

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE_BITS = 33  # of monotonically_increasing_id for the place within a partition


def feature_words(text: Column) -> Column:
    """Runs of digits, Latin letters in lower case (A-Z only) and all characters beyond ASCII; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def feature_buckets(words: Column, most: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``most`` consecutive words, repeats included."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")
    runs = lambda k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: bucket(F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(words, bucket), *(runs(k) for k in range(2, most + 1)))


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> list[int]:
    """Features of all ``texts`` in each bucket. Tasks send a total for each bucket, and the driver gets one for each."""
    words = texts.select(feature_words(F.col(text_col)).alias("words"))
    counted = words.select(F.explode(feature_buckets(F.col("words"), most, buckets)).alias("bucket")).groupBy("bucket").count()
    out = [0] * buckets
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / corpus share)) of each bucket, both shares with one added to every count."""
    n, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((target[i] + 1.0) * (s + n) / ((corpus[i] + 1.0) * (t + n)))) for i in range(n)]


def importance_scores(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", most: int = 1, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row; the weight is the sum of ``gains`` over its features."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    words = docs.select(F.col(id_col).alias("id"), feature_words(F.col(text_col)).alias("words"))
    placed = words.select("id", F.size("words").cast("bigint").alias("n_words"), feature_buckets(F.col("words"), most, len(gains)).alias("buckets"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chance = (F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(chance)))
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda s, b: s + F.element_at(table, b + 1))
    return placed.select("id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), noise.alias("noise")).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")
    )


def draw_ranks(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the ``percent`` of rows of ``least_words`` or more with the highest scores.

    Rows are sorted in ranges of (score, id), so that equal scores of many rows still spread, and written with their
    place within a range. Ranks are then that place and the number of rows in the ranges before; only a count for each
    range comes to the driver.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    able = scored.where(F.col("n_words") >= least_words)
    # sorted rows keep their order within and across partitions, also when adjacent ones are read together
    placed = materialize(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", _PLACE_BITS)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    drawn = percent * total // 100
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    if not total:
        return rest
    begins = spark.range(1).select(F.explode(F.from_json(F.lit("[" + ",".join(f'{{"part":{p},"start":{s}}}' for p, s in starts.items()) + "]"), "array<struct<part:bigint,start:bigint>>")).alias("b")).select("b.*")
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    most: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null for those not drawn).

    Features are runs of 1 to ``most`` words. Null and empty texts have none, weigh 0 and are never drawn unless
    ``least_words`` is 0; a null id takes its noise from the empty text and comes last among ties; repeated rows are drawn
    as often as they come, equal ones in any order; an empty target or an empty table leaves the counts at zero. Only the
    named columns are read, so others may bear any name.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets))
    scored = materialize(importance_scores(docs, gains, id_col, text_col, most, seed))
    return draw_ranks(scored, percent, least_words).withColumnRenamed("id", id_col)
