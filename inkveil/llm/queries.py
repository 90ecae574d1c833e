"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import oracles, pii
from inkveil.llm.alignment import align_documents
from inkveil.llm.encoding import encode_documents
from inkveil.llm.importance import resample
from inkveil.llm.language import FOLDS as LANGUAGE_FOLDS
from inkveil.llm.language import HELD_OUT as LANGUAGE_HELD_OUT
from inkveil.llm.language import identify_languages, train_languages
from inkveil.llm.neighbours import nearest_neighbours
from inkveil.llm.packing import pack_documents
from inkveil.llm.quality_classifier import FOLDS as QUALITY_FOLDS
from inkveil.llm.quality_classifier import HELD_OUT as QUALITY_HELD_OUT
from inkveil.llm.quality_classifier import score_quality, train_quality
from inkveil.llm.quality_rules import quality_rules
from inkveil.llm.secrets import find_secrets, labelled_samples, render, train_markov
from inkveil.llm.simhash import near_duplicates
from inkveil.llm.storage import id_bucket
from inkveil.llm.toxicity import FOLDS as TOXICITY_FOLDS
from inkveil.llm.toxicity import HELD_OUT as TOXICITY_HELD_OUT
from inkveil.llm.toxicity import score_toxicity, train_toxicity
from inkveil.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op2_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    held_out = (id_bucket("doc_id", TOXICITY_FOLDS) == TOXICITY_HELD_OUT).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_languages(docs)
    held_out = (id_bucket("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT).alias("held_out")
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out, "language.*")


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_markov(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(render(F.col("base_spans")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    held_out = (id_bucket("doc_id", QUALITY_FOLDS) == QUALITY_HELD_OUT).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    aligned = align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train_pii(spark))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)),
        F.sha2(pii.render(F.col("base_spans")), 256).alias("base_sha256"), pii.render(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_boundary_chain": op2_warc_boundary_chain,
    "op3_bpe_chunk_reuse": op3_bpe_chunk_reuse,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_pigeonring": op5_simhash_pigeonring,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_projected_neighbours": op8_projected_neighbours,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_pii_boosting": op13_pii_boosting,
}

ORACLES: dict[str, str] = {"op2_warc_boundary_chain": oracles.WARC, "op4_quality_rules": oracles.QUALITY_RULES, "op12_importance_resampling": oracles.IMPORTANCE}
