"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated by encoded length; from the documents and tokens at or beyond each length
follow the totals, quantiles and truncated totals for every context limit. Only the histogram is
ever ordered: its rows are bounded by the largest length, not by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pieces

CHUNK_CHARS = 1_000_000
#: Lengths in one bucket of the two-level suffix sums.
BUCKET = 1024


def lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each row; a null text has length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.library_encoder(tokenizer_path, ids=False)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            n = [sum(v) for i, j in pieces.chunks(texts, CHUNK_CHARS) for v in encoder.values(texts[i:j])]
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(n, pa.int64())})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, docs: one row for each length that occurs."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_table(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: docs and tokens of exactly L, documents and
    tokens at or beyond it, the total when every document is cut at L, and the share of documents
    shorter than or as long as L. An empty histogram gives no rows."""
    bucketed = hist.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    beyond = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    heads = bucketed.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    heads = heads.select("bucket", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    total = hist.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("tokens")).first()
    all_docs, all_tokens = F.lit(total["docs"]), F.lit(total["tokens"])
    return (
        bucketed.withColumn("d", F.sum("docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
        .join(F.broadcast(heads), "bucket")  # one row a bucket
        .select("n_tokens", "docs", "tokens", (F.col("d") + F.col("d_beyond")).alias("docs_at_least"), (F.col("t") + F.col("t_beyond")).alias("tokens_at_least"))
        .withColumn("truncated_total", all_tokens - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("share_at_most", (all_docs - F.col("docs_at_least") + F.col("docs")) / all_docs)
    )


def answers(table: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """kind, at, value: truncated totals at any limits (lengths that don't occur too) and exact lower quantiles."""
    q = [table.where(F.col("share_at_most") >= x).agg(F.min("n_tokens").cast("long").alias("value")).select(F.lit("quantile").alias("kind"), F.lit(float(x)).alias("at"), "value") for x in quantiles]
    cut = [table.agg(F.sum(F.col("docs") * F.least("n_tokens", F.lit(x))).cast("long").alias("value")).select(F.lit("truncated_total").alias("kind"), F.lit(float(x)).alias("at"), "value") for x in limits]
    rows = q + cut
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
