"""Readers and writers: whole text files, maps and payloads as JSON, encrypted maps, gazetteers as CSV."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPPING = "ord int, type string, original string, masked string, role string, source string, confidence double, restore_by_default boolean, reason string, entity_id string, do_not_merge array<string>, restore_original string"
MAP = f"version string, created_at string, mode string, source_file string, mappings array<struct<{', '.join(f.replace(' ', ':', 1) for f in MAPPING.split(', '))}>>"
ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")


@F.arrow_udf(T.StringType())
def decode_text(contents: pa.Array) -> pa.Array:
    """Bytes as text, by the first encoding of ENCODINGS that fits."""

    def one(data: bytes | None) -> str | None:
        for encoding in ENCODINGS if data is not None else ():
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return pa.array([one(x) for x in contents.to_pylist()], pa.string())


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(source_file, suffix, text, content_sha256) of text files; valid UTF-8 is decoded in the JVM."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    utf8 = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), utf8).otherwise(decode_text("content"))
    return files.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("source_file"), "suffix", text.alias("text"), F.sha2("content", 256).alias("content_sha256"))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Mapping entries (map_id and the MAPPING columns) of redaction maps, one JSON document per file."""
    maps = spark.read.schema(MAP).json(path, multiLine=True).withColumn("map_id", F.col("_metadata.file_name"))
    return maps.select("map_id", F.explode("mappings").alias("m")).select("map_id", "m.*")


def map_json(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, json): each map's entries in order as one JSON document."""
    fields = [c for c in mappings.columns if c != key]
    entries = F.array_sort(F.collect_list(F.struct(*sorted(fields, key=lambda c: c != "ord"))))
    return mappings.groupBy(key).agg(F.to_json(F.struct(F.lit("1").alias("version"), entries.alias("mappings"))).alias("json"))


def encrypt(text: Column, key: Column) -> Column:
    """AES-GCM with a random initialisation vector; ``key`` has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")))


def decrypt(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def read_divisions(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, ord) of a gazetteer in CSV with those columns or the first two."""
    return spark.read.schema("code string, name string, ord int").csv(path, header=True)


def write_divisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)


def write_texts(docs: DataFrame, path: str, text_col: str = "redacted") -> None:
    """Texts as Parquet with their columns; downstream stages read them column-wise."""
    docs.write.mode("errorifexists").parquet(path)
