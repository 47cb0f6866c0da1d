"""Tokens into sequences of fixed length, shuffled and sharded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from .selection import hash_key


def offsets(df: DataFrame, part: str = "source", key: str = "doc_id", length: str = "n_tokens", blocks: int = 1024) -> DataFrame:
    """start: tokens of the documents before it in its part. Prefix sums by blocks of keys, then inside each block:
    only block totals pass through one task a part. Keys must spread over their own range."""
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, width = span["lo"] or 0, max(1, ((span["hi"] or 0) - (span["lo"] or 0) + blocks) // blocks)
    rows = df.withColumn("__block", F.floor((F.col(key) - lo) / width))
    before = Window.partitionBy(part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(part, "__block").agg(F.sum(length).alias("__n")).select(part, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inside = Window.partitionBy(part, "__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col(part).alias("__part"), F.col("__block").alias("__head"), "__at")
    same = F.col(part).eqNullSafe(F.col("__part")) & F.col("__block").eqNullSafe(F.col("__head"))  # a null part is one of its own
    out = rows.withColumn("__in", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(heads, same)
    return out.withColumn("start", (F.col("__at") + F.col("__in")).cast("long")).drop("__block", "__in", "__at", "__part", "__head")


Tokenizer = Callable[[list[str]], list[list[int]]]


def tokenized(df: DataFrame, make: Callable[[], Tokenizer], end: int = C.END_OF_TEXT, text: str = "text") -> DataFrame:
    """df with tokens (array<int>, the end marker included) and n_tokens, by any tokenizer. make builds it once in a
    task, so that it need not be sent. A null text has its end marker only."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "tokens array<int>", "n_tokens int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [[*x, end] for x in encode([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])]
                columns = [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "tokens", "n_tokens"])

    return df.mapInArrow(run, schema)


#: Sequences in a shard.
SHARD_SEQUENCES = 131_072


def resharded(df: DataFrame, key: Column, size: int = SHARD_SEQUENCES, seed: int = C.SEED, buckets: int = 4096) -> DataFrame:
    """shard and place of each sequence, in a random order, with exactly size sequences in every shard but the last.

    The order is by md5, dealt into buckets of its first digits; counts of the buckets before are added to
    the number within, so that no task holds all rows. buckets: a power of two, 4096 at most."""
    h = hash_key(key, seed)
    rows = df.withColumn("__h", h).withColumn("__b", F.floor(F.conv(F.substring(h, 1, 3), 16, 10).cast("int") / (4096 // buckets)).cast("int"))
    heads = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    heads = heads.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"))
    number = F.row_number().over(Window.partitionBy("__b").orderBy("__h")) - 1
    out = rows.withColumn("__k", number).join(F.broadcast(heads), "__b").withColumn("__k", F.col("__k") + F.col("__at"))  # buckets rows
    return out.select(*df.columns, F.floor(F.col("__k") / size).cast("long").alias("shard"), (F.col("__k") % size).cast("long").alias("place"))


def pack(df: DataFrame, context: int = C.CONTEXT, end: int = C.END_OF_TEXT, part: str = "source") -> DataFrame:
    """part, seq, tokens (context of them). df: part, doc_id, start, tokens (its own end marker included).

    A document is cut where sequences end, never token by token. A last sequence at least half full is
    padded with end; a shorter one goes."""
    n = F.size("tokens")
    first, last = F.floor(F.col("start") / context), F.floor((F.col("start") + n - 1) / context)
    cut = df.where(n > 0).select(part, "start", "tokens", F.explode(F.sequence(first, last)).alias("seq"))
    begin = F.greatest(F.lit(0), F.col("seq") * context - F.col("start"))
    room = F.least(n - begin, (F.col("seq") + 1) * context - F.col("start") - begin)
    cut = cut.select(part, "seq", F.struct(F.greatest("start", F.col("seq") * context).alias("at"), F.slice("tokens", (begin + 1).cast("int"), room.cast("int")).alias("t")).alias("p"))
    rows = cut.groupBy(part, "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"])).alias("tokens"))  # context tokens at most
    full = F.concat("tokens", F.array_repeat(F.lit(end).cast("int"), context - F.size("tokens")))
    return rows.where(F.size("tokens") >= context // 2).select(part, F.col("seq").cast("long").alias("seq"), full.alias("tokens"))


def sequence_counts(totals: DataFrame, context: int = C.CONTEXT) -> DataFrame:
    """Of token totals: whole sequences, and one more for a tail at least half full."""
    tail = F.col("tokens") % context
    return totals.withColumn("sequences", (F.floor(F.col("tokens") / context) + (tail >= context // 2).cast("int")).cast("long"))


def mix_report(df: DataFrame, context: int = C.CONTEXT, part: str = "source") -> DataFrame:
    """Sequences and tokens of each part, and their share."""
    per = sequence_counts(df.groupBy(part).agg(F.sum("n_tokens").alias("tokens")), context)
    whole = per.agg(F.sum("sequences").alias("all"))
    return per.join(whole).select(part, "tokens", "sequences", F.round(F.when(F.col("all") > 0, F.col("sequences") * 100.0 / F.col("all")).otherwise(0.0), 4).alias("pct"))


def shuffled(df: DataFrame, key: Column, shards: int, seed: int = C.SEED) -> DataFrame:
    """shard and place of each sequence, in a random order that does not depend on the plan."""
    h = hash_key(key, seed)
    shard = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % shards).cast("int")
    return df.withColumn("shard", shard).withColumn("place", (F.row_number().over(Window.partitionBy("shard").orderBy(h)) - 1).cast("long"))


def epoch_order(df: DataFrame, epoch: int, seed: int = C.SEED, shard: str = "shard", seq: str = "seq_id") -> DataFrame:
    """Two levels: shards in an order of the epoch, sequences in one inside each shard."""
    s = seed + epoch
    return df.withColumn("shard_key", hash_key(F.col(shard), s)).withColumn("place", (F.row_number().over(Window.partitionBy(shard).orderBy(hash_key(F.col(seq), s))) - 1).cast("long"))


def worker_of(shards: DataFrame, workers: int, shard: str = "shard") -> DataFrame:
    """Contiguous shares whose sizes differ by one at most, the larger first. One row a shard."""
    return shards.withColumn("worker", F.ntile(workers).over(Window.orderBy(shard)) - 1)


def held_out(shards: DataFrame, n: int = 2, shard: str = "shard") -> DataFrame:
    return shards.withColumn("is_eval", F.row_number().over(Window.orderBy(F.desc(shard))) <= n)


def next_token_pairs(df: DataFrame) -> DataFrame:
    n = F.size("tokens")
    return df.withColumn("inputs", F.slice("tokens", F.lit(1), n - 1)).withColumn("targets", F.slice("tokens", F.lit(2), n - 1))


def checked(df: DataFrame, context: int = C.CONTEXT, vocabulary: int = C.VOCABULARY) -> DataFrame:
    """Raises on a sequence of another length, or a token beyond the vocabulary."""
    bad = (F.size("tokens") != context) | (F.array_max("tokens") >= vocabulary)
    return df.withColumn("tokens", F.when(bad, F.raise_error(F.lit("not a valid sequence"))).otherwise(F.col("tokens")))


def retained_checkpoints(steps: list[int], newest: int = 3, every: int = 10_000) -> list[int]:
    return sorted({*sorted(steps)[-newest:], *[s for s in steps if s % every == 0]})
