"""Sinks: shards, merged files, request files, reports, cards."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import tables


def write_shards(df: DataFrame, path: str, schema: T.StructType | None = None, rows: int = 1_000_000, by: str | None = None) -> None:
    """Parquet files of so many rows at most, with a fixed schema if one is given."""
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema]) if schema else df
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (writer.partitionBy(by) if by else writer).parquet(path)


#: Bytes of a merged file.
MERGED_BYTES = 500_000_000


def merge_shards(df: DataFrame, path: str, drop: tuple[str, ...] = ("dedup_cluster_id",), size: int = MERGED_BYTES) -> None:
    """Few large files: adaptive execution joins and splits partitions to size bytes of shuffled data each."""
    spark, name = df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        df.drop(*drop).hint("rebalance").write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def save_selection(chosen: DataFrame, path: str, key: str = "doc_id") -> None:
    """The ids that a selection chose, so that a write can be taken up again without choosing anew."""
    chosen.select(key).write.mode("overwrite").parquet(path)


def resume_write(wide: DataFrame, selection: str, path: str, rows: int = 1_000_000, key: str = "doc_id") -> int:
    """Write the rows of a saved selection; what an earlier attempt left is cleared. Returns the rows written, and
    raises if a chosen id is missing."""
    ids = wide.sparkSession.read.parquet(selection).distinct()
    wide.join(ids, key, "left_semi").write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    back = wide.sparkSession.read.parquet(path)
    missing = ids.join(back.select(key), key, "left_anti").count()
    if missing:
        raise RuntimeError(f"{path} lacks {missing} of the rows chosen")
    return back.count()


def validated_write(df: DataFrame, path: str) -> int:
    """Write, and hold the rows read back against those written; raises if they differ."""
    from pyspark.sql import Observation

    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    back, n = df.sparkSession.read.parquet(path).count(), counted.get["n"]
    if back != n:
        raise RuntimeError(f"{path}: {back} rows of {n}")
    return n


def write_any(df: DataFrame, path: str) -> None:
    """By suffix: csv, json or jsonl; otherwise parquet."""
    suffix = path.rsplit(".", 1)[-1]
    writer = df.write.mode("overwrite")
    if suffix == "csv":
        writer.csv(path, header=True, escape='"')
    elif suffix in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_progress(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_manifest(spark: SparkSession, path: str, batch_ids: list[str], metadata: dict[str, str]) -> None:
    write_report(spark.createDataFrame([(batch_ids, metadata)], "batch_ids array<string>, metadata map<string,string>"), path)


def _walks(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of n bytes: the bytes before each (and in all), and should a file begin with a line: the line with which the
    next one begins, how many files begin from there on, and the bytes in the last of these."""
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])
    then = np.maximum(np.searchsorted(at, at[:-1] + limit, "right") - 1, np.arange(1, len(at)))
    files, tail = np.ones(len(n), np.int64), at[-1] - at[:-1]
    for i in range(len(n) - 1, -1, -1):
        if (j := then[i]) < len(n):
            files[i], tail[i] = files[j] + 1, tail[j]
    return at, then, files, tail


def request_files(lines: DataFrame, limit: int = 150_000_000, part: str | None = None, key: str = "custom_id") -> DataFrame:
    """file: the request file of each line, in key order: a new one begins where the next line would exceed limit bytes.

    Exact greedy filling within each part. Lines are written in order, in blocks of a part's range of keys. All that a block
    has to know of those before it is the number of files and the bytes in the last one; for whatever these bytes are, its
    first lines (as many as a file holds) tell what they will be at its end. So blocks are summed up in parallel, a walk
    over these sums tells where each begins, and lines themselves are never gathered. A null line counts as an empty one."""
    rows = lines.withColumn("part", F.col(part) if part else F.lit("0")).select("part", key, "line")
    ordered = rows.repartitionByRange("part", key).sortWithinPartitions("part", key)
    ordered = tables.written(ordered.withColumn("__id", F.monotonically_increasing_id()), "request_lines")
    sizes = ordered.select("part", "__id", F.shiftright("__id", 33).alias("__block"), (F.coalesce(F.octet_length("line"), F.lit(0)) + 1).cast("long").alias("__n"))
    kind = dict(rows.dtypes)["part"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        at, _, files, tail = _walks(pdf["__n"].to_numpy(), limit)
        files, tail, upto = (x[at[:-1] < limit] for x in (files, tail, at[1:]))
        last = np.append((files[1:] != files[:-1]) | (tail[1:] != tail[:-1]), True)  # of lines with the same end
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "__block": [pdf["__block"].iloc[0]], "__in": [at[-1]], "__upto": [upto[last]], "__files": [files[last]], "__tail": [tail[last]]})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, held, first = None, -1, limit, True
        for b in batches:
            out = []
            for r in b.to_pylist():
                if first or r["part"] != now:
                    now, file, held, first = r["part"], -1, limit, False
                out.append((file, held))
                k = bisect_right(r["__upto"], limit - held)
                if k < len(r["__upto"]):
                    file, held = file + r["__files"][k], r["__tail"][k]
                else:
                    held += r["__in"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f for f, _ in out], pa.int64()), pa.array([h for _, h in out], pa.int64())], names=["part", "__block", "__file", "__held"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        file, held = int(pdf["__file"].iloc[0]), int(pdf["__held"].iloc[0])
        at, then, _, _ = _walks(pdf["__n"].to_numpy(), limit)
        begins = np.zeros(len(pdf), np.int64)
        i = int(np.searchsorted(at, limit - held, "right")) - 1 if held <= limit else 0
        while i < len(pdf):
            begins[i], i = 1, then[i]
        return pd.DataFrame({"__id": pdf["__id"], "file": file + np.cumsum(begins)})

    per = sizes.groupBy("part", "__block").applyInPandas(sums, f"part {kind}, __block long, __in long, __upto array<long>, __files array<long>, __tail array<long>")
    heads = per.repartition("part").sortWithinPartitions("part", "__block").mapInArrow(walk, f"part {kind}, __block long, __file long, __held long")
    heads = tables.written(heads, "request_blocks")  # a row a block
    same = F.col("part").eqNullSafe(F.col("__part")) & (F.col("__block") == F.col("__head"))
    begun = sizes.join(F.broadcast(heads.select(F.col("part").alias("__part"), F.col("__block").alias("__head"), "__file", "__held")), same)
    files = begun.groupBy("part", "__block").applyInPandas(number, "__id long, file int")
    return ordered.join(files, "__id").select("part", key, "line", "file")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a manifest of finished partitions leaves to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def swap(spark: SparkSession, new: str, old: str) -> None:
    """Put a rewritten folder in the old one's place: a plan can't overwrite what it reads. The old one is set
    aside first and goes only when the new one stands; should that fail, it comes back."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(old)
    fs = b.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{old.rstrip('/')}.old")
    if not fs.exists(a):
        raise RuntimeError(f"{new} does not exist")
    fs.delete(aside, True)
    had = fs.exists(b)
    if had and not fs.rename(b, aside):
        raise RuntimeError(f"{old} could not be set aside")
    if not fs.rename(a, b):
        if had:
            fs.rename(aside, b)
        raise RuntimeError(f"{new} could not take the place of {old}")
    fs.delete(aside, True)


def table_markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table for a dataset card."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows])


def dataset_card(title: str, sections: dict[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{table_markdown(df)}" for name, df in sections.items()) + "\n"


def running_files(lines: DataFrame, limit: int, key: str) -> DataFrame:
    """The same by running bytes divided by the limit: no Python, files only about as large as the limit."""
    w = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("file", F.floor((F.sum(F.octet_length("line") + 1).over(w) - 1) / limit).cast("int"))
