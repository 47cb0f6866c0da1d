"""The curation programmes as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import tables
from ..functions import scores, text
from ..operators import dedup, filters, selection


def web_meta(scored: DataFrame, threshold: float = C.TOPIC_THRESHOLD) -> DataFrame:
    """Gated rows with groups, bin and relevance."""
    ts = F.col("topic_scores")
    gated = filters.web_quality_gate(scored)
    return gated.withColumns({"assigned_groups": scores.assigned_groups(ts, threshold), "relevance": scores.web_relevance(ts, F.col("complexity")), "cbin": scores.complexity_bin(F.col("complexity"))})


def code_meta(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"language_slice": scores.language_slice(F.col("code_lang")), "relevance": scores.code_relevance(F.col("structured_data"), F.col("quality"))})


def web(scored: DataFrame, target: int, with_dedup: bool = True) -> DataFrame:
    """Validate, filter, select by priority, and keep one document of each cluster: full rows with groups,
    relevance and cluster. The selection is made on narrow columns; then the rows it chose are written, so that signatures,
    clusters and the result neither read nor score the whole input again."""
    meta = web_meta(scored)
    chosen, _ = selection.priority_sample(meta, target)
    rows = meta.join(chosen.select("doc_id"), "doc_id", "left_semi")
    if not with_dedup:
        return rows.withColumn("dedup_cluster_id", F.lit(-1).cast("long"))
    rows = tables.written(rows, "chosen")
    keys = dedup.shared_buckets(dedup.band_keys(dedup.signatures(rows, text.word_shingles(F.col("text")))))
    clusters = dedup.star_clusters(keys, rows.select("doc_id", "relevance"))
    return dedup.with_clusters(rows, clusters)


def code(scored: DataFrame, targets: dict[str, int], with_dedup: bool = True) -> DataFrame:
    """Select slices by strategy and keep one document of each cluster of like lines."""
    chosen = selection.select_slices(code_meta(scored), targets)
    if not with_dedup:
        return chosen
    rows = scored.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi")
    keys = dedup.shared_buckets(dedup.band_keys(dedup.signatures(rows, text.line_shingles(F.col("text")))))
    return dedup.with_clusters(chosen, dedup.star_clusters(keys, chosen.select("doc_id", "relevance")))
