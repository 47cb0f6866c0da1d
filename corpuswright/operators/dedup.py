"""Near duplicates as the curation programmes define them: MinHash over shingle sets, banded buckets, and greedy
star clusters in document order, of which the most relevant document stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables

PERMUTATIONS, BANDS = 128, 16
PRIME = (1 << 31) - 1


def coefficients(n: int = PERMUTATIONS, seed: int = 42) -> list[tuple[int, int]]:
    """Of the n permutations h -> (a h + b) mod PRIME: from md5, so that any engine can make them."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    return [(1 + number(f"a{seed}:{i}") % (PRIME - 1), number(f"b{seed}:{i}") % PRIME) for i in range(n)]


def shingle_hashes(shingles: Column) -> Column:
    """The first 31 bits of each shingle's md5, made where the text is. Repeats do no harm to minima."""
    return F.transform(shingles, lambda x: F.shiftright(F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"), 1).cast("int"))


def _least(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a h + b) mod PRIME. As PRIME is 2^31 - 1, the remainder is a sum of 31-bit halves."""
    low, p = np.full(len(a), PRIME, np.uint64), np.uint64(PRIME)
    for k in range(0, len(h), 256):
        x = h[k : k + 256, None].astype(np.uint64) * a + b
        for _ in range(2):
            x = (x & p) + (x >> np.uint64(31))
        np.minimum(low, np.where(x == p, np.uint64(0), x).min(axis=0), out=low)
    return low


#: Documents whose signatures leave a task at once.
SIGNED = 500


def signatures(df: DataFrame, shingles: Column, n: int = PERMUTATIONS, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """key, signature: array<long>, null for an empty set. Only hashes leave the engine, four bytes each, never shingles; they
    are read where Arrow holds them, and what is made beside them goes by documents, not by batches."""
    a, b = np.array(coefficients(n, seed), np.uint64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, cuts = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            for k in range(0, batch.num_rows, SIGNED):
                ends = cuts[k : k + SIGNED + 1]
                out = [_least(flat[i:j], a, b).astype(np.int64) if j > i else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(k, SIGNED), "signature": pa.array(out, pa.list_(pa.int64()))})

    return df.select(F.col(key), shingle_hashes(shingles).alias("h")).mapInArrow(run, f"{key} long, signature array<long>")


def band_keys(sig: DataFrame, bands: int = BANDS, n: int = PERMUTATIONS, key: str = "doc_id") -> DataFrame:
    """key, band, bucket."""
    if n % bands:
        raise ValueError(f"{n} permutations don't divide into {bands} bands")
    rows = n // bands
    each = F.array(*[F.md5(F.array_join(F.slice("signature", 1 + k * rows, rows), ",").cast("binary")) for k in range(bands)])
    return sig.where("signature IS NOT NULL").select(key, F.posexplode(each).alias("band", "bucket"))


def shared_buckets(keys: DataFrame) -> DataFrame:
    """Rows of buckets that hold several documents. Never pairs: a bucket of m documents is m rows."""
    keys = tables.written(keys, "bands")  # read twice: signatures are made once
    many = keys.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bucket")
    return keys.join(many, ["band", "bucket"], "left_semi")


def components(rows: DataFrame, key: str = "doc_id", most_rounds: int = 60) -> DataFrame:
    """key, component: the least key linked through shared buckets. rows: key, band, bucket.

    Labels pass from documents to buckets and back as minima, which are partial aggregates: a bucket of any
    size is never gathered. Each label then takes its own label's label, which halves long chains."""
    links = tables.written(rows.select(key, F.xxhash64("band", "bucket").alias("b")), "links")
    now = tables.written(links.select(key).distinct().withColumn("component", F.col(key)), "labels")
    for _ in range(most_rounds):
        low = links.join(now, key).groupBy("b").agg(F.min("component").alias("m"))
        new = links.join(low, "b").groupBy(key).agg(F.min("m").alias("component"))
        jump = new.select(F.col(key).alias("component"), F.col("component").alias("further"))
        new = tables.written(new.join(jump, "component", "left").select(key, F.coalesce("further", "component").alias("component")), "labels")
        if new.join(now.withColumnRenamed("component", "old"), key).where("component <> old").isEmpty():
            return new
        now = new
    raise RuntimeError("components have not settled")


#: After so many rounds, what is left (chains in the order of keys) is settled one component at a time.
ROUNDS = 30


def _met(links: DataFrame, state: DataFrame, sizes: DataFrame, total: int, key: str, **least: Column) -> DataFrame:
    """links (key, b) of documents in state, with minima over the documents of each bucket. A bucket of any size
    is a partial aggregate, and its minima reach its documents by broadcast: see tables.looked_up."""
    rows = links.join(state.hint("merge"), key)
    per = rows.groupBy("b").agg(*[F.min(c).alias(n) for n, c in least.items()]).join(sizes.hint("merge"), "b")
    return tables.looked_up(rows, per, ["b"], "n", total, [key])


def seeds(links: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """key, seed (whether it begins a cluster), and the documents that ROUNDS rounds leave open. links: key, b, written.

    A document begins a cluster if no smaller one that shares a bucket with it does. So in each round those that
    are the least open one in all of their buckets do, and what shares a bucket with them is decided."""
    total = links.count()
    sizes = tables.written(links.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "sizes")
    open_ = tables.written(links.select(key).distinct(), "open")
    decided = None
    for _ in range(ROUNDS):
        met = _met(links, open_, sizes, total, key, least=F.col(key))
        new = tables.written(met.groupBy(key).agg(F.min(F.col("least") == F.col(key)).alias("seed")).where("seed"), "seeds")
        # Open ones that share a bucket with a new seed are its own or an earlier one's.
        state = open_.join(new.hint("merge"), key, "left").select(key, F.coalesce("seed", F.lit(False)).alias("seed"))
        met = _met(links, state, sizes, total, key, near=F.when(F.col("seed"), F.col(key)))
        gone = tables.written(met.groupBy(key).agg(F.max("seed").alias("seed"), F.min("near").alias("near")).where("near IS NOT NULL").select(key, "seed"), "decided")
        left = tables.written(open_.join(gone.hint("merge"), key, "left_anti"), "open")
        tables.drop(open_, new)
        decided = gone if decided is None else decided.unionByName(gone)
        open_ = left
        if open_.isEmpty():
            break
    return decided, open_


def _settled(part: DataFrame, key: str) -> DataFrame:
    """key, seed of the open documents of links (key, b, component), each component in one task."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list] = {}
        for k, b in zip(pdf[key], pdf["b"], strict=True):
            held.setdefault(k, []).append(b)
        used: set = set()
        out = []
        for k in sorted(held):
            first = used.isdisjoint(held[k])
            if first:
                used.update(held[k])
            out.append((k, first))
        return pd.DataFrame(out, columns=[key, "seed"])

    return part.groupBy("component").applyInPandas(settle, f"{key} long, seed boolean")


def star_clusters(rows: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, cluster_id (-1 if it is alone), keep. rows: key, band, bucket; meta: key, relevance.

    In key order, each document not yet in a cluster takes all free documents that share a bucket with it.
    Of a cluster the most relevant stays, the seed first among equals, then the least key. A document without
    a relevance comes last."""
    links = tables.written(rows.select(key, F.xxhash64("band", "bucket").alias("b")).distinct(), "links")
    total = links.count()
    if not total:
        return rows.select(key, F.lit(-1).cast("long").alias("cluster_id"), F.lit(True).alias("keep")).limit(0)
    found, left = seeds(links, key)
    if not left.isEmpty():
        part = links.join(left, key, "left_semi")
        part = part.join(components(part.select(key, F.lit(0).alias("band"), F.col("b").alias("bucket")), key), key)
        found = found.unionByName(_settled(part, key))
    found = tables.written(found, "found")
    # Each document belongs to the least seed that shares a bucket with it; a seed to itself.
    sizes = links.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    met = _met(links, found, sizes, total, key, near=F.when(F.col("seed"), F.col(key)))
    own = met.groupBy(key).agg(F.max("seed").alias("seed"), F.min("near").alias("near"))
    own = own.select(key, F.when(F.col("seed"), F.col(key)).otherwise(F.col("near")).alias("cluster_id"), "seed").join(meta.select(key, "relevance"), key, "left")
    own = tables.written(own, "members")
    best = F.max_by(key, F.struct(F.coalesce("relevance", F.lit(float("-inf"))), "seed", -F.col(key)))
    clusters = own.groupBy("cluster_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    # The number of members is their weight, and tells whether a seed is alone.
    out = tables.looked_up(own, clusters.withColumn("many", F.col("n") > 1), ["cluster_id"], "n", total, [key])
    return out.select(key, F.when(F.col("many"), F.col("cluster_id")).otherwise(F.lit(-1)).alias("cluster_id"), (F.col("best") == F.col(key)).alias("keep"))


def keep_best(members: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of members (key, cluster_id, relevance, is_seed), the one of each cluster that stays."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("relevance"), F.desc("is_seed"), key)
    return members.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_clusters(df: DataFrame, clusters: DataFrame, key: str = "doc_id") -> DataFrame:
    """Surviving rows, with dedup_cluster_id (-1: in no cluster)."""
    out = df.join(clusters.select(key, "cluster_id", "keep"), key, "left").where("coalesce(keep, true)")
    return out.withColumn("dedup_cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("long"))).drop("cluster_id", "keep")


def cluster_stats(df: DataFrame, clusters: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total"))
    sums = clusters.agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.coalesce(F.sum((~F.col("keep")).cast("long")), F.lit(0)).alias("removed"))
    return total.join(sums).select("total", "clusters", "removed", (F.col("total") - F.col("removed")).alias("remaining"), F.round(F.when(F.col("total") > 0, F.col("removed") / F.col("total")).otherwise(0.0), 6).alias("rate"))


def first_by(df: DataFrame, what: Column, key: str = "doc_id") -> DataFrame:
    """The row of least key for each value: an aggregate, without a sort."""
    chosen = df.groupBy(what.alias("__v")).agg(F.min(key).alias(key)).select(key)
    return df.join(chosen, key, "left_semi")
