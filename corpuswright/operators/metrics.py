"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def multi_label_scores(df: DataFrame, truth: str, guess: str, names: list[str]) -> DataFrame:
    """label, precision, recall, f1, support; with rows `micro` and `macro`. truth, guess: array<boolean>. One scan."""
    cells = []
    for i, n in enumerate(names):
        t, g = F.get(truth, i), F.get(guess, i)
        cells.append(F.struct(F.lit(n).alias("label"), F.sum((t & g).cast("long")).alias("tp"), F.sum((~t & g).cast("long")).alias("fp"), F.sum((t & ~g).cast("long")).alias("fn")).alias(f"c{i}"))
    per = df.agg(*cells).select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))
    both = per.unionByName(per.agg(F.lit("micro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    p, r = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = both.select("label", p.alias("precision"), r.alias("recall"), _safe(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))
    macro = rated.where("label <> 'micro'").agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return rated.unionByName(macro).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def regression(df: DataFrame, truth: str, guess: str, low: int, high: int) -> DataFrame:
    t, g = F.col(truth).cast("double"), F.col(guess).cast("double")
    level = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(g)))
    return df.agg(F.round(F.avg((t - g) * (t - g)), 6).alias("mse"), F.round(F.avg(F.abs(t - g)), 6).alias("mae"), F.round(F.avg((level == t).cast("double")), 6).alias("accuracy"))


def by_level(df: DataFrame, truth: str, guess: str, low: int, high: int) -> DataFrame:
    """Of each level from low to high: precision, recall and F1 of the rounded and clipped guess, and support."""
    level = F.greatest(F.lit(low), F.least(F.lit(high), F.rint(F.col(guess).cast("double")).cast("int")))
    cells = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("int").alias("t"), level.alias("g")).groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"))
    each = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("level"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, g = F.col("t") == F.col("level"), F.col("g") == F.col("level")
    per = each.join(F.broadcast(cells), t | g, "left").groupBy("level").agg(count(t & g).alias("hit"), count(t).alias("support"), count(g).alias("found"))  # levels x levels cells
    scored = per.select("level", _safe(F.col("hit"), F.col("found")).alias("precision"), _safe(F.col("hit"), F.col("support")).alias("recall"), _safe(2.0 * F.col("hit"), F.col("support") + F.col("found")).alias("f1"), "support")
    return scored.select("level", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


RANK_BLOCKS = 4096


def _with_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """Average ranks, from the counts of distinct values. These are dealt into blocks of their range, and counts of the
    blocks before are added, so that no task orders all of them."""
    counts = df.groupBy(x).agg(F.count(F.lit(1)).alias("__n"))
    span = counts.agg(F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high")).first()
    low, width = span["low"] or 0.0, max((span["high"] or 0.0) - (span["low"] or 0.0), 1e-300)
    counts = counts.withColumn("__block", F.least(F.lit(RANK_BLOCKS - 1), F.floor((F.col(x).cast("double") - low) / width * RANK_BLOCKS)).cast("int"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.groupBy("__block").agg(F.sum("__n").alias("__m"))
    heads = heads.select("__block", F.coalesce(F.sum("__m").over(earlier.orderBy("__block")), F.lit(0)).alias("__at"))  # RANK_BLOCKS rows
    before = F.coalesce(F.sum("__n").over(earlier.partitionBy("__block").orderBy(x)), F.lit(0))
    ranks = counts.withColumn("__in", before).join(F.broadcast(heads), "__block")
    return df.join(ranks.select(x, (F.col("__at") + F.col("__in") + (F.col("__n") + 1) / 2.0).alias(name)), x)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return _with_rank(_with_rank(df.select(x, y), x, "__rx"), y, "__ry").agg(F.round(F.corr("__rx", "__ry"), 6).alias("spearman"))


def multi_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and macro F1, from the confusion counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("of_t"), F.lit(0).cast("long").alias("of_g"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("of_t"), F.col("n").alias("of_g"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("of_t", "of_g", "hit")])
    return per.agg(F.round(F.sum("hit") / F.sum("of_t"), 6).alias("accuracy"), F.round(F.avg(_safe(2.0 * F.col("hit"), F.col("of_t") + F.col("of_g"))), 6).alias("macro_f1"))
