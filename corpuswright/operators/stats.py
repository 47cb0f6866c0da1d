"""Distributions, overlaps, histograms and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import scores


def by_group(df: DataFrame, groups: str = "assigned_groups") -> DataFrame:
    """docs and tokens of each group (a document counts in each of its groups), zero rows included."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(g[0],) for g in C.GROUPS], "topic_group string")
    seen = df.select(F.explode(groups).alias("topic_group"), "token_count").groupBy("topic_group").agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    return dim.join(seen, "topic_group", "left").fillna(0, ["docs", "tokens"])


def by_label(df: DataFrame, threshold: float = C.TOPIC_THRESHOLD) -> DataFrame:
    """label, docs, pct: rows at or above the threshold."""
    hot = [F.sum((F.get("topic_scores", i) >= scores.f32(threshold)).cast("long")).alias(n) for i, n in enumerate(C.TOPIC_LABELS)]
    one = df.agg(F.count(F.lit(1)).alias("total"), *hot)
    return one.unpivot(["total"], list(C.TOPIC_LABELS), "label", "docs").select("label", "docs", scores.percent(F.col("docs"), F.col("total"), 4).alias("pct"))


def by_value(df: DataFrame, column: str) -> DataFrame:
    """docs, tokens, and their share of all tokens."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    total = df.agg(F.sum("token_count").alias("all_tokens"))
    return per.join(total).select(column, "docs", "tokens", scores.percent(F.col("tokens"), F.col("all_tokens"), 4).alias("pct"))


def by_bin(df: DataFrame, target: float, bins=C.COMPLEXITY_BINS, column: str = "cbin") -> DataFrame:
    """docs, tokens, their share of all tokens, and each bin's target tokens; a row for bins without rows too."""
    shares = F.create_map(*[F.lit(x) for b in bins for x in (b[0], float(b[3]))])
    dim = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b[0]) for b in bins])).alias(column))
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    whole = df.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("n")).first()["n"]
    out = dim.join(per, column, "left").fillna(0, ["docs", "tokens"])
    pct = scores.percent(F.col("tokens"), F.lit(whole), 4)
    return out.select(column, "docs", "tokens", pct.alias("pct"), F.round(shares[F.col(column)] * F.lit(float(target)), 4).alias("target"))


def slice_report(df: DataFrame, targets: dict[str, int], code_lang: str = "code_lang") -> DataFrame:
    """A row for each slice, empty ones too: docs and tokens by the slice that a row's language belongs to, means of
    scores by its own language_slice, and the target."""
    dim = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("language_slice"), F.lit(v).cast("long").alias("target")) for k, v in targets.items()])).alias("s")).select("s.*")
    sums = df.groupBy(scores.language_slice(F.col(code_lang)).alias("language_slice")).agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(f"mean_{c}")
    means = df.groupBy("language_slice").agg(mean("quality"), mean("structured_data"))
    return dim.join(sums, "language_slice", "left").join(means, "language_slice", "left").fillna(0, ["docs", "tokens"])


def summary(df: DataFrame, thresholds: list[float], scored: tuple[str, ...] = ("complexity",)) -> DataFrame:
    """One record of a run's statistics: rows, tokens (sum, percentiles), moments of each score, labels and groups,
    active labels by threshold, and the recommended threshold and floor. Each part is an aggregate of one row."""
    parts = {
        "tokens": percentiles(df, "token_count"), **{c: moments(df, c) for c in scored},
        "recommended": recommended_threshold(multi_label(df, thresholds)), "floor": recommended_floor(df),
        "labels": by_label(df).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "docs")))).alias("docs")),
        "multi_label": multi_label(df, thresholds).agg(F.sort_array(F.collect_list(F.struct("threshold", "mean_labels", "pct_0", "pct_1", "pct_2plus", "pct_3plus"))).alias("at")),
    }
    out = df.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("all_tokens"))
    for name, part in parts.items():
        out = out.crossJoin(part.select(F.struct(*part.columns).alias(name)))  # one row each
    return out


def multi_label(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: mean active labels, and the shares of rows with none, one, two or more, three or more. One scan."""
    aggs = []
    for k, t in enumerate(thresholds):
        n = scores.active_labels(F.col("topic_scores"), t)
        share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 4)
        aggs.append(F.struct(F.lit(t).alias("threshold"), F.round(F.avg(n), 4).alias("mean_labels"), share(n == 0).alias("pct_0"), share(n == 1).alias("pct_1"), share(n >= 2).alias("pct_2plus"), share(n >= 3).alias("pct_3plus")).alias(f"s{k}"))
    return df.agg(*aggs).select(F.inline(F.array(*[f"s{k}" for k in range(len(thresholds))])))


def groups_by_threshold(df: DataFrame, thresholds: list[float]) -> DataFrame:
    aggs = [F.sum(scores.in_group(F.col("topic_scores"), labels, t).cast("long")).alias(f"{g}|{t}") for t in thresholds for g, labels, _, _ in C.GROUPS]
    cells = [F.struct(F.lit(t).alias("threshold"), F.lit(g).alias("topic_group"), F.col(f"`{g}|{t}`").alias("docs")) for t in thresholds for g, _, _, _ in C.GROUPS]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def co_occurrence(df: DataFrame, threshold: float = C.TOPIC_THRESHOLD) -> DataFrame:
    """i, j, docs: 17 x 17 counts. Rows are counted by their set of labels, as a number; the sets make the cells."""
    n = len(C.TOPIC_LABELS)
    bits = F.transform("topic_scores", lambda x, i: F.when(x >= scores.f32(threshold), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    sets = df.groupBy(F.aggregate(bits, F.lit(0), lambda a, x: a + x).alias("set")).agg(F.count(F.lit(1)).alias("k"))
    both = lambda i, j: (F.col("set").bitwiseAND(1 << i | 1 << j) == (1 << i | 1 << j))
    upper = sets.agg(*[F.coalesce(F.sum(F.when(both(i, j), F.col("k"))), F.lit(0)).alias(f"{i}_{j}") for i in range(n) for j in range(i, n)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{min(i, j)}_{max(i, j)}").alias("docs")) for i in range(n) for j in range(n)]
    return upper.select(F.inline(F.array(*cells)))


def co_occurrence_rates(cells: DataFrame) -> DataFrame:
    support = cells.where("i = j").select("i", F.when(F.col("docs") == 0, 1).otherwise(F.col("docs")).alias("support"))
    return cells.join(F.broadcast(support), "i").select("i", "j", F.round(F.col("docs") / F.col("support"), 6).alias("rate"))  # 17 rows


def correlations(df: DataFrame, vector: str, n: int) -> DataFrame:
    aggs = [F.corr(F.get(vector, i).cast("double"), F.get(vector, j).cast("double")).alias(f"{i}_{j}") for i in range(n) for j in range(i + 1, n)]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(F.col(f"{i}_{j}"), 6).alias("corr")) for i in range(n) for j in range(i + 1, n)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def group_by_bin(df: DataFrame, value: Column) -> DataFrame:
    """A row for each topic group, a column for each complexity bin."""
    names = [b[0] for b in C.COMPLEXITY_BINS]
    rows = df.select(F.explode("assigned_groups").alias("topic_group"), "cbin", value.alias("v"))
    return rows.groupBy("topic_group").pivot("cbin", names).agg(F.sum("v")).fillna(0, names)


def totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of row x column with all totals; null stands for all."""
    return df.cube(row, column).agg(F.count(F.lit(1)).alias("docs"))


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    p = F.percentile(column, F.array(*[F.lit(x) for x in at]))
    return df.agg(p.alias("p"), F.round(F.avg(column), 4).alias("mean")).select(*[F.get("p", i).cast("long").alias(f"p{round(x * 100)}") for i, x in enumerate(at)], "mean")


def moments(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.median(x), 6).alias("median"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"), F.round(F.stddev_samp(x), 6).alias("sample_std"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal widths, the last bin closed; values outside are left out."""
    x = F.col(column).cast("double")
    spot = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins))).cast("int")
    return df.where(x.between(low, high)).groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("docs"))


def top(df: DataFrame, column: str, n: int, by: str = "docs") -> DataFrame:
    sums = df.groupBy(column).agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    return sums.orderBy(F.desc(by), column).limit(n)


def shares_of_groups(df: DataFrame) -> DataFrame:
    """Of each topic group: rows, and their share of all rows and of all assignments (a row has several)."""
    rows = df.select(F.explode("assigned_groups").alias("topic_group")).groupBy("topic_group").agg(F.count(F.lit(1)).alias("docs"))
    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("assigned_groups")), F.lit(0)).alias("assigned")).first()
    return rows.select("topic_group", "docs", scores.percent(F.col("docs"), F.lit(whole["rows"]), 4).alias("pct_docs"), scores.percent(F.col("docs"), F.lit(whole["assigned"]), 4).alias("pct_assigned"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("docs"))


def fill_status(tokens: Column, target: Column) -> Column:
    return F.when(tokens >= 0.9 * target, "ok").when(tokens >= 0.5 * target, "shortfall").when(tokens > 0, "low").otherwise("empty")


def slice_fill(selected: DataFrame, targets: dict[str, int]) -> DataFrame:
    dim = selected.sparkSession.createDataFrame(list(targets.items()), "language_slice string, target long")
    sums = selected.groupBy("language_slice").agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    out = dim.join(sums, "language_slice", "left").fillna(0, ["docs", "tokens"])
    return out.withColumn("status", fill_status(F.col("tokens"), F.col("target")))


def recommended_threshold(by_threshold: DataFrame) -> DataFrame:
    """The least threshold with few rows of several labels and few of none; 0.3 if there is none."""
    good = by_threshold.where("pct_2plus < 40 AND pct_0 < 10").agg(F.min("threshold").alias("t"))
    return good.select(F.coalesce("t", F.lit(0.3)).alias("threshold"))


def recommended_floor(df: DataFrame, floors: tuple[float, ...] = (0.2, 0.25, 0.3, 0.35, 0.4)) -> DataFrame:
    best = scores.max_score(F.col("topic_scores"))
    below = df.agg(*[F.avg(F.when(best < scores.f32(t), 100.0).otherwise(0.0)).alias(f"b{k}") for k, t in enumerate(floors)])
    return below.select(F.coalesce(*[F.when(F.col(f"b{k}") < 5, t) for k, t in enumerate(floors)], F.lit(0.3)).alias("floor"))


def last_per_run(metrics: DataFrame, run: str = "run", step: str = "shard_idx") -> DataFrame:
    rest = [c for c in metrics.columns if c != run]
    return metrics.groupBy(run).agg(F.max_by(F.struct(*rest), step).alias("m")).select(run, "m.*")


def best_run(last: DataFrame) -> DataFrame:
    return last.where("return_code = 0").orderBy(F.desc("docs_per_sec"), "run").limit(1)


def phase_shares(metrics: DataFrame, phases: list[str]) -> DataFrame:
    sums = metrics.agg(*[F.sum(p).alias(p) for p in phases])
    whole = sum((F.col(p) for p in phases[1:]), F.col(phases[0]))
    return sums.select(*[scores.percent(F.col(p), whole, 2).alias(p) for p in phases])
