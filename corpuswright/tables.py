"""Intermediate tables in the folder that driver and executors share, and joins that a hot key can't gather."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_made: dict[str, SparkSession] = {}
#: A key is hot if it holds more than one in HOT of all rows, so that there are fewer than HOT such keys.
HOT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corpuswright-"))
    return "file://" + _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpuswright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and a lost executor
    costs no more than the stages that follow."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def drop(*written_tables: DataFrame) -> None:
    """Remove tables of written() that no later step reads."""
    for df in written_tables:
        delete(df.sparkSession, df.__dict__["_written_at"])


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


def looked_up(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, spread: list[Column | str]) -> DataFrame:
    """rows left-joined with lookup, which has one row for each value of `on` (no nulls) and says in weight how
    many of the total rows have it.

    Keys with more than a HOTth of the rows, fewer than HOT by that, are broadcast; their rows stay where
    they are or are dealt out by the hash of spread. The other keys meet in a shuffle. lookup is read twice."""
    values = [c for c in lookup.columns if c not in (*on, weight)]
    hot = lookup.where(F.col(weight) * HOT > max(total, 1_000 * HOT)).select(*on, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    tagged = rows.join(F.broadcast(hot), on, "left")
    is_hot = F.col("__hot").isNotNull()
    # A hot row's first key gives way to a hash; should that meet a key, the hot value stands.
    kinds = dict(rows.dtypes)
    mixed = F.xxhash64(*spread)
    other = mixed.cast(kinds[on[0]])
    keys = [F.when(is_hot, other).otherwise(F.col(on[0])).alias("__k0"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(on) if i]]
    right = lookup.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"__cold_{c}") for c in values]).hint("merge")
    out = tagged.select("*", *keys).join(right, [f"__k{i}" for i in range(len(on))], "left")
    return out.select(*rows.columns, *[F.when(is_hot, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in values])
