"""Sharding by balanced label propagation.

Documents of equal text are linked; shards are labels. Every linked document starts at the shard its
key hashes to. In each round, joins of (group, shard) counts let documents move to the shard where
most of their group stands, as far as that shard's quota has room: where more want in than fit, each
group's request is granted in part, in a total order, by running sums kept per shard and slice. Every
move goes to a shard that holds more of the group, so that the links within shards only grow, and rounds go
on until none moves. The state is one row for each group and shard, never one for each pair of linked
documents, so that a group of any size is a few rows. At last what still lies over a quota, and all documents without a
link, fill up the shards to sizes at most one apart (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables

#: Rows in one slice of a numbering, so that no task holds all rows of a shard or a group; LEAST_SLICES in any case.
SLICE_ROWS, LEAST_SLICES = 200_000, 64


def slices_of(total: int) -> int:
    """The number of slices grows with the rows."""
    return max(LEAST_SLICES, -(-total // SLICE_ROWS))


def _before(value: str, part: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, part: list[str], order: list[Column | str], name: str, slices: int) -> DataFrame:
    """df with a gapless number from 0 within part (no nulls there), in a fixed order.

    Rows are dealt to slices of each part by a hash of the order; a slice is numbered alone, and
    the counts of the slices before it are added."""
    sliced = tables.written(df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")), "sliced")
    within = Window.partitionBy(*part, "__slice").orderBy(*order)
    counts = sliced.groupBy(*part, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*part, "__slice", _before("__n", part, ["__slice"]).alias("__start"))
    ranked = sliced.withColumn("__rank", F.row_number().over(within) - 1)
    out = ranked.join(starts.hint("merge"), [*part, "__slice"]).withColumn(name, (F.col("__rank") + F.col("__start")).cast("long"))
    return out.select(*df.columns, name)


def cut_edges(state: DataFrame) -> tuple[int, int]:
    """Of links between documents of a group: how many there are, and how many of them join different shards."""
    squares = state.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("same"))
    pairs = squares.select((F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2).alias("edges"), ((F.col("n").cast("decimal(38,0)") * F.col("n") - F.col("same")) / 2).alias("cut"))
    found = pairs.agg(F.sum("edges").alias("edges"), F.sum("cut").alias("cut")).first()
    return int(found["edges"] or 0), int(found["cut"] or 0)


def label_propagation(state: DataFrame, quotas: DataFrame, slices: int) -> DataFrame:
    """state: group, shard, n (documents of the group there), written. quotas: shard, quota. Returns the same, written,
    when no document moves any more.

    A shard's inflow of a round never exceeds the room it had when the round began, so no quota is
    overrun by moves."""
    while True:
        best = state.groupBy("group").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("to"))
        # Counts of a group on a few shards: at most one row for each shard.
        wishes = state.join(best, "group").withColumn("moves", F.when(F.col("shard") != F.col("to"), F.col("n")).otherwise(0))
        held = state.groupBy("shard").agg(F.sum("n").alias("held"))
        room = quotas.join(held, "shard", "left").select(F.col("shard").alias("to"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
        wishes = wishes.withColumn("slice", F.pmod(F.xxhash64("group"), F.lit(slices)))
        per_slice = wishes.groupBy("to", "slice").agg(F.sum("moves").alias("asked"))
        starts = per_slice.select("to", "slice", _before("asked", ["to"], ["slice"]).alias("start")).join(F.broadcast(room), "to")  # one row a shard
        granted = F.greatest(F.lit(0), F.least(F.col("moves"), F.col("room") - F.col("start") - _before("moves", ["to", "slice"], ["group", "shard"])))
        moved = wishes.join(starts, ["to", "slice"]).withColumn("granted", granted)
        stay = F.struct("shard", (F.col("n") - F.col("granted")).alias("n"), F.lit(0).cast("long").alias("came"))
        go = F.struct(F.col("to").alias("shard"), F.col("granted").alias("n"), F.col("granted").alias("came"))
        after = moved.select("group", F.explode(F.array(stay, go)).alias("s")).select("group", "s.*")
        after = after.groupBy("group", "shard").agg(F.sum("n").alias("n"), F.sum("came").alias("came")).where("n > 0")
        after = tables.written(after, "labels")
        tables.drop(state)
        state = after
        if state.where("came > 0").isEmpty():
            return state


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32 (of a null
    text: of no bytes), law `rows`, shard (0 to shards - 1; counts at most one apart), slot (gapless from 0
    in each shard), grown_shard (null: this law does not define it).

    Null texts are one group, as equal texts are, and empty ones another. Rows that repeat a doc_id are rows
    of their own. Texts of any length count whole. Other columns, whatever their names, are ignored. An
    empty table gives no rows; fewer rows than shards leave some shards empty."""
    data = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.md5(F.concat(F.when(F.col(text_col).isNull(), F.lit(b"n")).otherwise(F.lit(b"t")), data)).alias("group"),
    )
    rows = tables.written(rows, "rows")
    total = rows.count()
    slices = slices_of(total)
    quota = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    quotas = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), quota.cast("long").alias("quota"))

    # Linked documents, counted by group and first label.
    first = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")
    state = rows.select("group", first.alias("shard")).groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = tables.written(state.groupBy("group").agg(F.sum("n").alias("in_group")).where("in_group > 1"), "sizes")
    state = tables.written(state.join(sizes.select("group").hint("merge"), "group", "left_semi"), "labels")
    state = label_propagation(state, quotas, slices)

    # What a shard may keep of its groups, up to its quota.
    sliced = state.select("group", "shard", "n", F.pmod(F.xxhash64("group"), F.lit(slices)).alias("slice"))
    starts = sliced.groupBy("shard", "slice").agg(F.sum("n").alias("n")).select("shard", "slice", _before("n", ["shard"], ["slice"]).alias("start")).join(F.broadcast(quotas), "shard")  # one row a shard
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("start") - _before("n", ["shard", "slice"], ["group"])))
    keeps = tables.written(sliced.join(starts, ["shard", "slice"]).select("group", "shard", kept.alias("n")).where("n > 0"), "keeps")
    ranges = keeps.select("group", "shard", _before("n", ["group"], ["shard"]).alias("low"), "n").withColumn("high", F.col("low") + F.col("n")).drop("n")
    by_group = ranges.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("low", "high", "shard"))).alias("ranges"))  # a row a shard at most

    # Number the documents of a group, and put them into the group's ranges. A group of any size is dealt out.
    known = tables.written(sizes.join(by_group, "group", "left"), "ranges")
    placed = tables.looked_up(rows, known.withColumn("linked", F.lit(True)), ["group"], "in_group", total, ["doc_id"])
    placed = tables.written(placed, "linked")
    tables.drop(rows, sizes, state, keeps, known)
    linked = numbered(placed.where("linked").drop("linked"), ["group"], ["doc_id", "size"], "number", slices)
    spot = F.get(F.filter("ranges", lambda r: (r["low"] <= F.col("number")) & (F.col("number") < r["high"])), F.lit(0))["shard"]
    linked = linked.withColumn("shard", spot).drop("ranges", "number")
    whole = linked.unionByName(placed.where("linked IS NULL").drop("linked", "ranges").withColumn("shard", F.lit(None).cast("int")))
    whole = tables.written(whole, "placed")
    tables.drop(placed)

    # The rest fill what room is left, in a fixed order.
    left = quotas.join(whole.where("shard IS NOT NULL").groupBy("shard").agg(F.count(F.lit(1)).alias("held")), "shard", "left")
    left = left.select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
    free = numbered(whole.where("shard IS NULL").drop("shard").withColumn("all", F.lit(0)), ["all"], ["group", "doc_id"], "number", slices).drop("all")
    upto, spot = 0, F.lit(None).cast("int")
    gaps = []
    for r in sorted(left.collect(), key=lambda r: r["shard"]):  # one row a shard
        upto += r["room"]
        gaps.append((upto, r["shard"]))
    for end, shard in reversed(gaps):
        spot = F.when(F.col("number") < end, shard).otherwise(spot)
    filled = whole.where("shard IS NOT NULL").unionByName(free.withColumn("shard", spot).drop("number"))
    out = numbered(filled, ["shard"], ["group", "doc_id"], "slot", slices)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
