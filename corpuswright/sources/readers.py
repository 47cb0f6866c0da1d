"""Scans: parquet folders, mixed schemas, suffixes, early stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..operators.selection import hash_key


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, dumps: list[str] | None = None, dump: str = "dump") -> DataFrame:
    """A parquet folder, recursively; columns are pruned and dumps pushed into the scan. Nulls of token_count are 0."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    if dumps:
        df = df.where(F.col(dump).isin(dumps))
    if columns:
        df = df.select(*columns)
    return df.withColumn("token_count", F.coalesce("token_count", F.lit(0))) if "token_count" in df.columns else df


def language_of_path(path: Column) -> Column:
    """The folder that holds a file, without a `lang=` in front."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "^(lang|language)=", "")


def scan_code(spark: SparkSession, paths: list[str]) -> DataFrame:
    """content, lang, size from folders whose schemas differ: lang or language or the folder's name; size or the text's bytes.
    Folders without content are left out."""
    out = None
    for path in paths:
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
        if "content" not in df.columns:
            continue
        # The file's path is known only on the scan itself.
        named = [F.col(c).cast("string") for c in ("lang", "language") if c in df.columns]
        size = [F.col("size").cast("long")] if "size" in df.columns else []
        df = df.select("content", F.coalesce(*named, language_of_path(F.col("_metadata.file_path"))).alias("lang"), F.coalesce(*size, F.octet_length("content").cast("long"), F.lit(0).cast("long")).alias("size"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no folder has a column content")
    return out


def early_stop(files: DataFrame, part: str, targets: Column, factor: float = 2.0, seed: int = C.SEED) -> DataFrame:
    """Files (path, tokens, part) to read: in a random order, until factor times the target is reached."""
    w = Window.partitionBy(part).orderBy(hash_key(F.col("path"), seed), "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long")).where(F.col("before") < targets * factor)


SUFFIXES = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "gz": "json"}


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: parquet, csv, json (an array), jsonl, json.gz. Globs and folders of one format work as well."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError(f"{path}: none of {', '.join(SUFFIXES)}")
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
    return reader.option("multiLine", suffix == "json").format(SUFFIXES[suffix]).load(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of every file below a folder, glob or file; listed by the engine, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def with_overrides(sources: list[dict], overrides: dict[str, str | None]) -> list[dict]:
    """Sources (name, repo, ...) in which a given repo takes the place of the default; None leaves it. A name that no
    source has is an error."""
    unknown = set(overrides) - {s["name"] for s in sources}
    if unknown:
        raise ValueError(f"no sources named {', '.join(sorted(unknown))}")
    return [{**s, "repo": overrides.get(s["name"]) or s["repo"]} for s in sources]


def row_count(df: DataFrame) -> int:
    """From footers alone, for parquet."""
    return df.count()


def read_request_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a labelling job's result file."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_manifest(spark: SparkSession, path_or_id: str) -> list[str]:
    """Job ids of a manifest; anything that isn't a .json path is an id itself."""
    if not path_or_id.endswith(".json"):
        return [path_or_id]
    return spark.read.schema("batch_ids array<string>, metadata map<string,string>").option("multiLine", True).json(path_or_id).first()["batch_ids"]
