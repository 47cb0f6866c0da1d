"""Budgeted selection, samples and splits.

A budget cut keeps, in a given order, every row before which no more than the budget has been taken. The
order is by two numbers, and all that has to be found is where in it the budget runs out: one pair of
numbers for each part. Aggregates over BUCKETS of the first number's range give the bucket where that
happens; its range is cut into BUCKETS again, and where the first number ties, the second one's. When a
bucket has few rows, these are sorted. So the input is read once (it is written, if it isn't yet), no
task holds a whole slice's rows whatever the numbers' distribution, and the result is a filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from .. import tables
from ..functions import scores, text

BUCKETS = 4096
#: A bucket of so many rows is sorted; larger ones are cut again.
SORTED_ROWS = 50_000
#: Stands for null and NaN, which come last.
LAST = 1e308


def hash_key(key: Column, seed: int = C.SEED) -> Column:
    """A random order that any engine can reproduce: md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


class Order(NamedTuple):
    """Ascending: a double, then a long. Rows that are equal in both are taken or left as one wishes."""

    first: Column
    second: Column


def by_hash(key: Column, seed: int = C.SEED) -> Order:
    """The order of hash_key, by its first 25 hexadecimal digits."""
    h = hash_key(key, seed)
    return Order(F.conv(F.substring(h, 1, 13), 16, 10).cast("double"), F.conv(F.substring(h, 14, 12), 16, 10).cast("long"))


def falling(x: Column, key: Column) -> Order:
    """x falls, and NaN and null come last; among equals, key ascends."""
    return Order(F.when(x.isNull() | F.isnan(x), F.lit(LAST)).otherwise(-x.cast("double")), key.cast("long"))


class Cut(NamedTuple):
    """Of one part: the last row taken. None: no row, or all of them."""

    all: bool
    first: float = 0.0
    second: int = 0


def cuts(rows: DataFrame, budget: Column, order: Order, part: list[str], tokens: str = "token_count", strict: bool = False) -> dict[tuple, Cut]:
    """Where each part's budget runs out. rows should be written, as they are read some times.

    Parts are few (bins, slices, sources): each has one row on the driver. A null part is one of its own.
    budget may depend on part only; a null one takes nothing. strict: rows are taken while less than the
    budget is in. Null tokens count as none."""
    fits = (lambda x, most: x < most) if strict else (lambda x, most: x <= most)
    narrow = rows.select(*part, order.first.alias("__k1"), order.second.alias("__k2"), F.coalesce(tokens, F.lit(0)).alias("__n"), budget.cast("double").alias("__budget"))
    ends = [f(c).alias(f"__{n}{c[-1]}") for c in ("__k1", "__k2") for n, f in (("lo", F.min), ("hi", F.max))]
    whole = narrow.groupBy(*part).agg(F.max("__budget").alias("__budget"), F.sum("__n").alias("__in"), F.count(F.lit(1)).alias("__rows"), *ends).collect()
    out: dict[tuple, Cut] = {}
    open_: dict[tuple, dict] = {}
    for r in whole:
        key, most = tuple(r[c] for c in part), r["__budget"]
        if most is None or not fits(0, most):
            out[key] = Cut(False, -float("inf"))
        elif fits(r["__in"], most):
            out[key] = Cut(True)
        else:
            open_[key] = r.asDict() | {"__before": 0}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*part).schema), "__before double, __budget double, __lo1 double, __hi1 double, __lo2 long, __hi2 long"])

    def inside(states: dict[tuple, dict]) -> DataFrame:
        """Rows within the open range of their part."""
        known = rows.sparkSession.createDataFrame([(*k, float(s["__before"]), s["__budget"], s["__lo1"], s["__hi1"], s["__lo2"], s["__hi2"]) for k, s in states.items()], schema)
        known = known.select(*[F.col(c).alias(f"__part{i}") for i, c in enumerate(part)], *[c for c in known.columns if c not in part])
        on = F.lit(True)
        for i, c in enumerate(part):
            on = on & F.col(c).eqNullSafe(F.col(f"__part{i}"))
        within = F.col("__k1").between(F.col("__lo1"), F.col("__hi1")) & ((F.col("__lo1") < F.col("__hi1")) | F.col("__k2").between(F.col("__lo2"), F.col("__hi2")))
        return narrow.drop("__budget").join(F.broadcast(known), on & within)  # a row a part

    while wide := {k: s for k, s in open_.items() if s["__rows"] > SORTED_ROWS and (s["__lo1"] < s["__hi1"] or s["__lo2"] < s["__hi2"])}:
        spot = lambda k: F.least(F.lit(BUCKETS - 1), F.floor((F.col(f"__k{k}") - F.col(f"__lo{k}")) / (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * BUCKETS))
        bucket = F.when(F.col("__lo1") < F.col("__hi1"), spot(1)).otherwise(spot(2)).alias("__bucket")
        sums = inside(wide).groupBy(*part, "__before", "__budget", bucket).agg(F.sum("__n").alias("__in"), F.count(F.lit(1)).alias("__rows"), *ends)
        before = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__in").over(before), F.lit(0)))
        for r in sums.where(fits(F.col("__before"), F.col("__budget")) & ~fits(F.col("__before") + F.col("__in"), F.col("__budget"))).collect():
            open_[tuple(r[c] for c in part)] = r.asDict()
    if open_:
        run = Window.partitionBy(*part).orderBy("__k1", "__k2").rowsBetween(Window.unboundedPreceding, -1)
        taken = inside(open_).withColumn("__run", F.col("__before") + F.coalesce(F.sum("__n").over(run), F.lit(0))).where(fits(F.col("__run"), F.col("__budget")))
        last = taken.groupBy(*part).agg(F.max(F.struct("__k1", "__k2")).alias("__last"))
        for r in last.collect():
            out[tuple(r[c] for c in part)] = Cut(False, r["__last"]["__k1"], r["__last"]["__k2"])
    return out


def taken_by(found: dict[tuple, Cut], order: Order, part: list[str]) -> Column:
    """Whether a row stands at or before its part's cut. A part that found lacks takes nothing."""
    out = F.lit(False)
    for key, cut in found.items():
        mine = F.lit(True)
        for c, v in zip(part, key, strict=True):
            mine = mine & F.col(c).eqNullSafe(F.lit(v))
        before = (order.first < cut.first) | (order.first == cut.first) & (order.second <= cut.second)
        out = out | (mine if cut.all else mine & before)
    return out


def budget_cut(df: DataFrame, budget: Column, order: Order, part: list[str] | None = None, tokens: str = "token_count", strict: bool = False) -> DataFrame:
    """Rows whose tokens before them (in order, within part) are at most the budget; strict: below it.

    df is written once, unless it is a written table already. See cuts()."""
    rows = df if "_written_at" in df.__dict__ else tables.written(df, "candidates")
    return rows.where(taken_by(cuts(rows, budget, order, part or [], tokens, strict), order, part or []))


def relevance_to_budget(df: DataFrame, budget: Column, part: list[str] | None = None, relevance: str = "relevance", key: str = "doc_id") -> DataFrame:
    return budget_cut(df, budget, falling(F.col(relevance), F.col(key)), part)


def random_to_budget(df: DataFrame, budget: Column, part: list[str] | None = None, seed: int = C.SEED, strict: bool = False, key: str = "doc_id") -> DataFrame:
    return budget_cut(df, budget, by_hash(F.col(key), seed), part, strict=strict)


def in_order_to_budget(df: DataFrame, budget: Column, part: list[str], key: str = "doc_id") -> DataFrame:
    """Packing's rule: a document goes in while fewer than the budget's tokens are in (strict)."""
    return budget_cut(df, budget, Order(F.lit(0.0), F.col(key).cast("long")), part, strict=True)


def bin_share() -> Column:
    """The share of a target that a complexity bin has."""
    return scores.lookup(F.col("cbin"), {b[0]: str(b[3]) for b in C.COMPLEXITY_BINS}).cast("double")


def with_complexity_targets(df: DataFrame, target: Column) -> DataFrame:
    """Each complexity bin's share of the target, by relevance; what a bin leaves unfilled is not passed on."""
    return relevance_to_budget(df, bin_share() * target, ["cbin"])


#: What a slice takes, by the name of its strategy: rows that may enter, and the order in which they do. Register more here.
Strategy = tuple[Callable[[str], Column], Callable[[int], Order]]
STRATEGIES: dict[str, Strategy] = {
    "relevance_filter": (
        lambda least: (F.col("quality") > scores.f32(C.QUALITY_FLOOR)) & (F.col("structured_data").cast("double") >= float(least)),
        lambda seed: falling(F.col("relevance"), F.col("doc_id")),
    ),
    "keyword_filter": (lambda least: text.any_keyword(F.col("text"), C.KEYWORDS), lambda seed: by_hash(F.col("doc_id"), seed)),
}
#: Slices of any other strategy take rows by length alone, in random order.
BY_LENGTH: Strategy = (lambda least: F.lit(True), lambda seed: by_hash(F.col("doc_id"), seed))
#: Strategies whose rows have model scores; the others get defaults.
SCORED = ("relevance_filter",)


def select_slices(df: DataFrame, targets: dict[str, int], seed: int = C.SEED, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """doc_id, language_slice and scores: one plan for all slices, each with its strategy of STRATEGIES (or of the
    given ones). Only conditions and orders differ, so that one budget cut over the slices serves all."""
    known = {**STRATEGIES, **(strategies or {})}
    good, first, second, ranked = F.lit(False), F.lit(0.0), F.lit(0).cast("long"), F.lit(False)
    for name, _, strategy, least, _ in C.SLICES:
        enter, order = known.get(strategy, BY_LENGTH)
        mine, key = F.col("language_slice") == name, order(seed)
        good = good | mine & enter(least)
        first, second = F.when(mine, key.first).otherwise(first), F.when(mine, key.second).otherwise(second)
        ranked = ranked | mine & F.lit(strategy in SCORED)
    rows = df.where(F.col("token_count").between(*C.CODE_TOKENS)).where(good)
    budget = scores.lookup(F.col("language_slice"), {k: str(v) for k, v in targets.items()}).cast("double")
    order = Order(F.col("__first"), F.col("__second"))
    keep = ("doc_id", "language_slice", "token_count", "quality", "structured_data", "content_type", "relevance")
    rows = rows.select(*keep, first.alias("__first"), second.alias("__second"), ranked.alias("__ranked"))
    kept = budget_cut(rows, budget, order, ["language_slice"])
    # Slices that no model scores get defaults.
    defaults = (("quality", scores.f32(0.0)), ("structured_data", scores.f32(0.0)), ("content_type", F.lit("unclassified")), ("relevance", F.lit(0.0)))
    return kept.select("doc_id", "language_slice", "token_count", *[F.when(F.col("__ranked"), F.col(c)).otherwise(d).alias(c) for c, d in defaults])


def priority_sample(meta: DataFrame, target: float, threshold: float = C.TOPIC_THRESHOLD) -> tuple[DataFrame, list[dict]]:
    """The selected rows (doc_id, group that took it), and a report of each group.

    meta: doc_id, topic_scores, token_count, cbin, relevance, of gated rows. Groups take in order of
    priority what they still need beyond rows already selected that belong to them too. A group's choice is
    where each bin's budget ran out, so that all choices together are one filter over the rows, which are
    written once. Sums by set of groups (2,048 at most) tell the driver what each group has."""
    groups = sorted(C.GROUPS, key=lambda g: g[3])
    bit = {g[0]: 1 << i for i, g in enumerate(groups)}
    mask = sum((F.when(scores.in_group(F.col("topic_scores"), labels, threshold), bit[g]).otherwise(0) for g, labels, _, _ in groups), F.lit(0))
    narrow = tables.written(meta.select("doc_id", "token_count", "cbin", "relevance", mask.alias("groups")), "meta")
    order = falling(F.col("relevance"), F.col("doc_id"))
    sums = lambda df: {r["groups"]: (r["n"], r["t"] or 0) for r in df.groupBy("groups").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t")).collect()}
    held, taken = sums(narrow), {}
    of = lambda by, b, i: sum(v[i] for m, v in by.items() if m & b)
    chosen: list[tuple[str, Column]] = []
    report = []
    for group, _, share, _ in groups:
        b = bit[group]
        row = {"group": group, "candidates": of(held, b, 0), "target": share * target}
        if not row["candidates"]:
            report.append(row | {"tokens": 0, "status": "empty"})
            continue
        if group == "general":
            row["target"] = max(0.0, target - sum(v[1] for v in taken.values()))
        have = of(taken, b, 1)
        need = max(0.0, row["target"] - have)
        free_rows = row["candidates"] - of(taken, b, 0)
        if need <= 0 or not free_rows:
            report.append(row | {"tokens": have, "status": "filled_by_overlap" if need <= 0 else "no_candidates"})
            continue
        member = F.col("groups").bitwiseAND(b) > 0
        free = member
        for _, before in chosen:
            free = free & ~before
        found = cuts(narrow.where(free), bin_share() * need, order, ["cbin"])
        mine = member & taken_by(found, order, ["cbin"])
        for m, (n, t) in sums(narrow.where(free & mine)).items():
            old = taken.get(m, (0, 0))
            taken[m] = (old[0] + n, old[1] + t)
        chosen.append((group, mine))
        tokens = of(taken, b, 1)
        report.append(row | {"tokens": tokens, "status": "ok" if tokens >= 0.9 * row["target"] else "shortfall"})
    # The first group in order of priority has a row that several would take.
    by = F.coalesce(*[F.when(c, g) for g, c in chosen], F.lit(None).cast("string")) if chosen else F.lit(None).cast("string")
    return narrow.select("doc_id", by.alias("taken_by")).where("taken_by IS NOT NULL"), report


def sample(df: DataFrame, n: int, seed: int = C.SEED, key: str = "doc_id") -> DataFrame:
    """n rows, uniformly without replacement."""
    return df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def sample_per_key(df: DataFrame, by: str, n: int, seed: int = C.SEED, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(hash_key(F.col(key), seed), key)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def numbered(df: DataFrame, by: str, order: Order, name: str, blocks: int = BUCKETS) -> DataFrame:
    """df with the number (from 0) of each row in its value of by.

    Rows are dealt into blocks of the range of both numbers, and counts of the blocks before are added to the number
    within one, so that no task holds all rows of a value. Numbers that pile up make large blocks."""
    rows = df.withColumns({"__k1": order.first, "__k2": order.second})
    span = rows.agg(F.min("__k1").alias("a"), F.max("__k1").alias("b"), F.min("__k2").alias("c"), F.max("__k2").alias("d")).first()
    if span["a"] is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    # A single first number leaves the blocks to the second one.
    x, low, high = ("__k1", span["a"], span["b"]) if span["a"] < span["b"] else ("__k2", span["c"], span["d"])
    block = F.least(F.lit(blocks - 1), F.floor((F.col(x) - low) / max(high - low, 1e-300) * blocks))
    rows = rows.withColumn("__block", block.cast("int"))
    heads = rows.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__by").orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col(by).alias("__by"), F.col("__block").alias("__head"), "__n").withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(by, "__block").orderBy("__k1", "__k2")) - 1
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__head"))
    return rows.withColumn("__k", number).join(heads, same).select(*df.columns, (F.col("__k") + F.col("__at")).cast("long").alias(name))


def interleaved(df: DataFrame, by: str = "lang", block: int = 50_000, key: str = "doc_id") -> DataFrame:
    """turn: the round in which a row is read when each value of by gives block rows a round."""
    rows = numbered(df, by, Order(F.lit(0.0), F.col(key).cast("long")), "turn")
    return rows.withColumn("turn", F.floor(F.col("turn") / block).cast("long"))


def length_batches(df: DataFrame, length: Column, size: int, by: str, key: str = "doc_id") -> DataFrame:
    """batch: of rows of like length, in each value of by."""
    rows = numbered(df, by, Order(length.cast("double"), F.col(key).cast("long")), "batch")
    return rows.withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def split(df: DataFrame, by: str | None = None, test: float = 0.1, validation: float = 0.1, seed: int = C.SEED, key: str = "doc_id") -> DataFrame:
    """part: test, validation or train, of exact sizes (in each value of by): the second cut takes validation / (1 - test) of the rest.

    Both cuts are budget cuts of rows in random order: no value's rows are gathered. Values of by are few."""
    part = [by] if by else []
    rows = tables.written(df.withColumn("__one", F.lit(1)), "to_split")
    order = by_hash(F.col(key), seed)
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a value
    n_test, n_val = {}, {}
    for r in sizes:
        k = tuple(r[c] for c in part)
        n_test[k] = math.ceil(r["n"] * test)
        n_val[k] = math.ceil((r["n"] - n_test[k]) * (validation / (1 - test)))

    def least(limits: dict[tuple, int]) -> Column:
        out = F.lit(0)
        for k, n in limits.items():
            out = F.when(F.col(by).eqNullSafe(F.lit(k[0])), n).otherwise(out) if by else F.lit(n)
        return out

    # Strict budgets of rows: as many rows as the budget says.
    below = lambda limits: taken_by(cuts(rows, least(limits), order, part, "__one", strict=True), order, part)
    tested, validated = below(n_test), below({k: n + n_val[k] for k, n in n_test.items()})
    return rows.withColumn("part", F.when(tested, "test").when(validated, "validation").otherwise("train")).drop("__one")
