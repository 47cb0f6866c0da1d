"""Token ids in directly addressable codes.

Every id is cut into chunks of CHUNK_BITS bits, lowest first. Level 0 holds the first chunk of all
ids; a bit for each says whether the id goes on, and level k + 1 holds the next chunk of just those
that go on. A rank directory counts the set bits before every RANK_BITS bits of a level's bitmap, so
the place of any id's next chunk is found by one addition: token i is read by at most one access to
each level, without decoding what stands before it.

A segment is one file: header, document directory, levels, and a byte that ends it. Files are neither
compressed nor framed, so that a reader seeks to the bytes of any token (StoredSegment). Spark's own
writer makes them, one row a file, so that its committer handles retries, and a lost executor's work is
redone without double output. In the order of their names, segments ascend with doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables
from . import pieces

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1_000_000
#: Bytes of texts encoded at a time by a worker.
CHUNK_BYTES = 4_000_000

#: Names of a writer's files: the task, then the file within it.
_NAME = r"part-(\d+)-.*-c(\d+)[^/]*$"


def pack_levels(ids: np.ndarray) -> bytes:
    """ids (unsigned 32 bits) as levels: count, then chunks, bitmap and rank directory of each."""
    out, rest = [], ids.astype(np.uint32)
    levels = 0
    while True:
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        on = (rest >> CHUNK_BITS) > 0
        bits = np.packbits(on, bitorder="little")
        pad = -len(bits) % (RANK_BITS // 8)
        padded = np.concatenate([bits, np.zeros(pad, np.uint8)])
        per_block = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32) if len(padded) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        out.append(struct.pack("<QQQ", len(chunk), len(padded), len(ranks)) + chunk.tobytes() + padded.tobytes() + ranks.tobytes())
        levels += 1
        rest = rest[on] >> CHUNK_BITS
        if not len(rest):
            return struct.pack("<I", levels) + b"".join(out)


class Levels:
    """Random access to packed ids."""

    def __init__(self, image: memoryview | bytes, at: int = 0):
        (n,) = struct.unpack_from("<I", image, at)
        at += 4
        self.levels = []
        for _ in range(n):
            c, b, r = struct.unpack_from("<QQQ", image, at)
            at += 24
            chunk = np.frombuffer(image, np.uint8, c, at)
            bits = np.frombuffer(image, np.uint8, b, at + c)
            ranks = np.frombuffer(image, "<u4", r, at + c + b)
            at += c + b + 4 * r
            self.levels.append((chunk, bits, ranks))
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before place i: the directory's count, then those inside one block."""
        block = i // RANK_BITS
        begin = block * (RANK_BITS // 8)
        whole = i // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[begin:whole]).sum())
        return n + (int(bits[whole] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            shift += CHUNK_BITS
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin to end: one rank lookup a level, then only those tokens' own chunks."""
        out = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        shift = 0
        for chunk, bits, ranks in self.levels:
            if not len(where):
                break
            out[where] |= chunk[begin:end].astype(np.uint32) << np.uint32(shift)
            shift += CHUNK_BITS
            low = begin // 8
            on = np.unpackbits(bits[low : -(-end // 8)], bitorder="little")[begin - 8 * low : end - 8 * low].astype(bool)
            begin = self._rank(bits, ranks, begin)
            where = where[on]
            end = begin + len(where)
        return out


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """Header; doc_id and first token of each document; levels. A null doc_id has its own flag."""
    known = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()
    return MAGIC + struct.pack("<IQ", len(doc_ids), len(ids)) + known + docs + starts + pack_levels(ids)


class Segment:
    def __init__(self, image: bytes):
        if bytes(image[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n, self.n_tokens = struct.unpack_from("<IQ", image, 4)
        at = 16
        known = np.unpackbits(np.frombuffer(image, np.uint8, -(-n // 8), at), bitorder="little")[:n]
        at += -(-n // 8)
        docs = np.frombuffer(image, "<i8", n, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        self.starts = np.frombuffer(image, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.levels = Levels(image, at + 8 * n + 8 * (n + 1))

    def document(self, i: int) -> np.ndarray:
        return self.levels.slice(int(self.starts[i]), int(self.starts[i + 1]))


class StoredSegment:
    """A segment file, of which only the bytes asked for are read. The store may be any that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        self._stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        self.bytes_read = 0
        head = self._read(0, 16)
        if head[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n_docs, self.n_tokens = struct.unpack_from("<IQ", head, 4)
        self._docs = 16 + -(-self.n_docs // 8)
        self._starts = self._docs + 8 * self.n_docs
        at = self._starts + 8 * (self.n_docs + 1)
        (levels,) = struct.unpack("<I", self._read(at, 4))
        at += 4
        self._levels = []
        for _ in range(levels):
            c, b, r = struct.unpack("<QQQ", self._read(at, 24))
            self._levels.append((at + 24, at + 24 + c, at + 24 + c + b))
            at += 24 + c + b + 4 * r

    def _read(self, at: int, n: int) -> bytes:
        self._stream.seek(at)
        self.bytes_read += n
        return bytes(self._stream.readNBytes(n))

    def doc_id(self, k: int) -> int | None:
        known = self._read(16 + k // 8, 1)[0] >> (k % 8) & 1
        return struct.unpack("<q", self._read(self._docs + 8 * k, 8))[0] if known else None

    def find(self, doc_id: int) -> int | None:
        """The number of the first document with this id, by bisection; documents without an id come first."""
        low, high = 0, self.n_docs
        while low < high:
            mid = (low + high) // 2
            at = self.doc_id(mid)
            low, high = (mid + 1, high) if at is None or at < doc_id else (low, mid)
        return low if low < self.n_docs and self.doc_id(low) == doc_id else None

    def length(self, k: int) -> int:
        begin, end = struct.unpack("<QQ", self._read(self._starts + 8 * k, 16))
        return end - begin

    def token(self, k: int, i: int) -> int:
        """Token i of document k: at each level a byte, a bit, a directory entry and a part of one block."""
        begin, end = struct.unpack("<QQ", self._read(self._starts + 8 * k, 16))
        if not 0 <= i < end - begin:
            raise IndexError(i)
        at, value = begin + i, 0
        for n, (chunks, bits, ranks) in enumerate(self._levels):
            value |= self._read(chunks + at, 1)[0] << (n * CHUNK_BITS)
            block = at // RANK_BITS
            inside = self._read(bits + block * (RANK_BITS // 8), at // 8 - block * (RANK_BITS // 8) + 1)
            if not inside[-1] >> (at % 8) & 1:
                break
            (before,) = struct.unpack("<I", self._read(ranks + 4 * block, 4))
            at = before + (int.from_bytes(inside, "little") & ((1 << (at % RANK_BITS)) - 1)).bit_count()
        return value

    def close(self) -> None:
        self._stream.close()


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """image: segments of all documents in ascending doc_id order (null first; then by a hash of the text).

    A null text counts as empty; rows that repeat a doc_id stay apart; an empty table gives no
    segments; texts of any length count whole; other columns are ignored. end_id is appended to each document."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.library_encoder(tokenizer_path, ids=True)
        names, counts, found, size = [], [], [], 0

        def flush():
            nonlocal names, counts, found, size
            ids = np.frombuffer(b"".join(found), "<u4")
            row = pa.RecordBatch.from_pydict({"image": pa.array([pack_segment(names, counts, ids)], pa.binary())})
            names, counts, found, size = [], [], [], 0
            return row

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            texts = b.column(1)
            for i, j in pieces.chunks(texts, CHUNK_BYTES):
                ((ids_of, first, last),) = encoder.joined(texts.slice(i, j - i))
                for doc, at, to in zip(doc_ids[i:j], first, last, strict=True):
                    data = bytes(ids_of[at:to]) + end
                    names.append(doc)
                    counts.append(len(data) // 4)
                    found.append(data)
                    size += counts[-1]
                    if size >= SEGMENT_TOKENS:
                        yield flush()
        if names:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ranges are cut by short keys: the sample of keys that reaches the driver holds no texts.
    keyed = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return keyed.select("doc_id", "text").mapInArrow(run, "image binary")


def write(segments: DataFrame, path: str) -> None:
    """One file for each segment. Text files hold a row's bytes as they are, and one line end."""
    segments.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, part, file (their order), content of each segment file."""
    rows = spark.read.format("binaryFile").load(path).where("length > 0")
    number = lambda k: F.regexp_extract("path", _NAME, k).cast("long")
    return rows.select("path", number(1).alias("part"), number(2).alias("file"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, n_docs, n_tokens, first and last doc_id of each segment file: which to open for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(image.as_py())
                ids = [d for d in s.doc_ids if d is not None]
                yield pa.RecordBatch.from_pydict({"path": [name], "n_docs": pa.array([len(s.doc_ids)], pa.int64()), "n_tokens": pa.array([s.n_tokens], pa.int64()), "first": pa.array(ids[:1] or [None], pa.int64()), "last": pa.array(ids[-1:] or [None], pa.int64())})

    return files(spark, path).select("path", "content").mapInArrow(run, "path string, n_docs long, n_tokens long, first long, last long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        for b in batches:
            for part, file, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Segment(image.as_py())
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(len(s.doc_ids))]
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_pydict({"part": long([part] * len(crc)), "file": long([file] * len(crc)), "doc_id": long(s.doc_ids), "inside": long(s.starts[:-1]), "n_tokens": long(np.diff(s.starts)), "ids_crc32": long(crc)})

    # The files stay where they are: only the narrow rows made of them meet the starts.
    read = files(spark, path).select("part", "file", "content").mapInArrow(run, "part long, file long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    read = tables.written(read, "token_rows")
    sizes = read.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the writer, then for each segment inside it.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("at"))
    within = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("file")), F.lit(0))
    starts = sizes.withColumn("within", within).join(parts, "part").select("part", "file", (F.col("at") + F.col("within")).alias("at"))
    return read.join(starts, ["part", "file"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """read_documents() of all documents, written and read back. Nulls, repeats and empty tables as in encode()."""
    spark = docs.sparkSession
    path = tables.new_path(spark, "token_store")
    write(encode(docs, tokenizer_path, end_id), path)
    return read_documents(spark, path)
