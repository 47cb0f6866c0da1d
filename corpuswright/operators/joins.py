"""Lookups, label merges and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


#: The languages whose raw folders tell of a text's language, in the order in which they are read.
REPAIR_LANGUAGES = ("typescript", "python", "rust", "go", "java", "jupyter")


def repair_language(shards: DataFrame, raw: DataFrame, languages: tuple[str, ...] = REPAIR_LANGUAGES, content: str = "content") -> DataFrame:
    """Where lang is `unknown` and there is text: the language of the raw row of the same content hash. Raw rows of
    other languages tell nothing; of several languages, the last in the given order stands."""
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    known = raw.where(F.col("lang").isin(*languages)).select(text.content_hash(F.col(content)).alias("__hash"), F.col("lang").alias("__lang"), place.alias("__at"))
    known = known.groupBy("__hash").agg(F.max_by("__lang", "__at").alias("__lang"))
    joined = shards.withColumn("__hash", text.content_hash(F.col(content))).join(known, "__hash", "left")
    fits = (F.col("lang") == "unknown") & (F.length(content) > 0)
    return joined.withColumn("lang", F.when(fits, F.coalesce("__lang", "lang")).otherwise(F.col("lang"))).select(*shards.columns)


def merge_with_defaults(rows: DataFrame, labels: DataFrame, key: str, defaults: dict) -> DataFrame:
    return rows.join(labels, key, "left").fillna(defaults)


def merge_matched(rows: DataFrame, labels: DataFrame, key: str, group: str) -> DataFrame:
    """Labelled rows only; of a key in several groups of rows, those of the first group."""
    first = F.min(group).over(Window.partitionBy(key))
    return rows.join(labels, key).withColumn("__first", first).where(F.col(group) == F.col("__first")).drop("__first")


def update(rows: DataFrame, labels: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """columns from labels where the key is labelled; of rows that repeat a key, the last one by place alone."""
    new = labels.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    last = F.col(place) == F.max(place).over(Window.partitionBy(key))
    out = rows.withColumn("__last", last).join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__last"), F.coalesce(f"__{c}", c)).otherwise(F.col(c)))
    return out.select(*rows.columns)


def full_rows(wide: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Late materialisation: decide on narrow columns, then read wide rows once."""
    return wide.join(chosen.select(key), key, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def union_of(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
