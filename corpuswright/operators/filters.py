"""Gates, and the counts of what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores, text


def web_gate_parts(ts: Column, tokens: Column, floor: float = C.AMBIGUITY_FLOOR, limits: tuple[int, int] = C.WEB_TOKENS) -> dict[str, Column]:
    return {"ambiguous": ~(scores.max_score(ts) >= scores.f32(floor)), "too_short": tokens < limits[0], "too_long": tokens > limits[1]}


def _gate(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    for bad in parts.values():
        df = df.where(~bad)
    return df


def web_quality_gate(df: DataFrame, **options) -> DataFrame:
    return _gate(df, web_gate_parts(F.col("topic_scores"), F.col("token_count"), **options))


def code_gate_parts(quality: Column, tokens: Column, floor: float = C.QUALITY_FLOOR, limits: tuple[int, int] = C.CODE_TOKENS) -> dict[str, Column]:
    return {"low_quality": ~(quality > scores.f32(floor)), "too_short": tokens < limits[0], "too_long": tokens > limits[1]}


def code_quality_gate(df: DataFrame, **options) -> DataFrame:
    return _gate(df, code_gate_parts(F.col("quality"), F.col("token_count"), **options))


def drop_counts(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row: total, rows under each fault (a row may have several), kept."""
    good = ~F.lit(False)
    for bad in parts.values():
        good = good & ~bad
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total"), *[count(bad).alias(name) for name, bad in parts.items()], count(good).alias("kept"))


def length_gate(df: DataFrame, limits: tuple[int, int] = C.CODE_TOKENS) -> DataFrame:
    return df.where(F.col("token_count").between(*limits))


def not_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.col(column).rlike(r"\S"))


def compressible(df: DataFrame, column: str, floor: float = C.ZLIB_FLOOR) -> DataFrame:
    """Drop what deflates to less than floor of its size, and empty text."""
    return df.where(text.compression_ratio(F.col(column)) >= floor)


def allowed_values(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    for name, values in allowed.items():
        df = df.where(F.col(name).isin(values))
    return df


def valid_levels(df: DataFrame, column: str = "reasoning_complexity", levels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    return df.where(F.col(column).isin(*levels))


def valid_code_labels(df: DataFrame) -> DataFrame:
    """Failed labels (quality 0) go; unknown content types become `other`."""
    kind = F.when(F.col("content_type").isin(*C.CONTENT_TYPES), F.col("content_type")).otherwise("other")
    return df.where(F.col("quality") != 0).withColumn("content_type", kind)


def unfinished(df: DataFrame, output: str) -> DataFrame:
    return df.where(F.col(output).isNull())


def head(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return df.orderBy(key).limit(n)
