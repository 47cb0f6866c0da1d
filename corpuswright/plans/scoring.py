"""Scorers: anything that adds score columns to a table.

No model comes with the engine. The default derives every score from the md5 of key and name, so that any
engine reproduces it; a model is plugged in as a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

#: df -> df with more columns.
Scorer = Callable[[DataFrame], DataFrame]


def thousandth(key: Column, name: str) -> Column:
    """0 to 999."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{name}")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000


def _cubed(key: Column, name: str) -> Column:
    """0 to 1, mostly low, as topic scores are."""
    h = thousandth(key, name)
    return ((h * h * h).cast("double") / F.lit(1e9)).cast("float")


CODE_LANGUAGES = ("json", "typescript", "python", "rust", "jupyter-scripts-dedup-filtered", "github-issues-filtered-structured", "c", "SQL", "klingon")


def hashed_scores(df: DataFrame, key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """topic_scores, complexity, quality, structured_data, content_type, code_lang, token_count, dump."""
    k = F.col(key)
    part = lambda name, low, span: (F.lit(low) + thousandth(k, name).cast("double") * span / F.lit(999.0)).cast("float")
    pick = lambda name, values: F.get(F.array(*[F.lit(v) for v in values]), (thousandth(k, name) % len(values)).cast("int"))
    return df.withColumns({
        "topic_scores": F.array(*[_cubed(k, str(i)) for i in range(len(C.TOPIC_LABELS))]),
        "complexity": part("complexity", 1.0, 3.0), "quality": part("quality", 1.0, 4.0), "structured_data": part("structured_data", 0.0, 3.0),
        "content_type": pick("content_type", C.CONTENT_TYPES), "code_lang": pick("code_lang", CODE_LANGUAGES),
        "token_count": F.floor(F.col(size) / 4).cast("long"), "dump": F.col("source"),
    })


def batch_scorer(predict: Callable[[list[str]], dict[str, list]], text: str, schema: str) -> Scorer:
    """A model as a scorer: predict(texts) -> columns of schema (e.g. `topic_scores array<float>, complexity float`).
    Results stay with their rows; other columns pass through."""

    def score(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(**predict([t or "" for t in pdf[text]]))

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{own}, {schema}")

    return score


def resumable(df: DataFrame, scorer: Scorer, column: str, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that have a score keep it; the scorer sees only the others."""
    todo = df.join(done.where(F.col(column).isNotNull()).select(key), key, "left_anti")
    return done.where(F.col(column).isNotNull()).unionByName(scorer(todo).select(*done.columns))
