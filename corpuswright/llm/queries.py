"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).path(name)


def tokenizer_pattern() -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).PATTERN


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    return token_store.write_and_read(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    return shards.balanced_shards(_read(spark, sf_dir, "documents"), shards=40)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import tables
    from . import token_counts

    hist = token_counts.histogram(token_counts.lengths(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
    return token_counts.suffix_table(tables.written(hist, "lengths"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.write_and_read(_read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_and_decode(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import license_scan

    return {"op2_license_scan": license_scan.oracle()}
