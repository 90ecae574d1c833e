"""A training corpus from raw documents: rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns to shared storage as Parquet and gives it to
the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.packing import SmallSegments, pack_documents
from inkveil.llm.quality_rules import quality_rules
from inkveil.llm.secrets import find_secrets, labelled_samples, redact, train_markov
from inkveil.llm.simhash import SIMILARITY, first_of_groups
from inkveil.llm.storage import materialize
from inkveil.llm.toxicity import score_toxicity, train_toxicity

#: Differing bits of 64 at which documents are near copies here: a changed word or two in a text of some length.
NEAR_BITS, MOST_IN_KEY = 3, 48

#: Of the rows that an executor gives a Python worker at once; Spark's 64 MB are held several times over by both.
BATCH_BYTES = "4m"


def _small_batches(spark: SparkSession) -> None:
    """For the session from here on, since a plan takes its batches' size when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep."""
    whole = docs.withColumn("__row", F.struct(*docs.columns))
    return quality_rules(whole, carry=("__row",)).where("kept").select("__row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on this stage's labelled documents, does not reject."""
    _small_batches(spark)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, score="__score", predicted="__predicted")
    return scored.where("__predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row with the smallest id of each near-duplicate group; rows without an id stay."""
    _small_batches(spark)
    return first_of_groups(docs, distance=NEAR_BITS, most=MOST_IN_KEY, similarity=SIMILARITY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked."""
    found = find_secrets(docs, train_markov(labelled_samples(docs)), base="__base", spans="__spans")
    masked = found.withColumn("text", redact(F.col("text"), F.col("__spans")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 places: a row for each piece of a document, with its tokens."""
    _small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), segments=SmallSegments)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_by_rules),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", one_of_each_group),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: SQL cannot express the trained model, the shingle hashes and the tokeniser; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
