"""Token shards as a data source: a header of 16 bytes (magic, version, context, sequences, vocabulary), then the
sequences as unsigned 16-bit integers. A partition holds shards up to a number of bytes, so that small ones don't make a
task each; with headerOnly, only headers are read."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC, VERSION = b"TKDS", 1
HEADER = "<4sHHII"
SCHEMA = "shard string, seq_id long, tokens array<int>"
HEADERS = "shard string, version int, context int, sequences long, vocabulary long"
#: Bytes of the shards that one task reads (a larger shard is a task of its own), and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 32_000_000, 64_000


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def pack_shard(tokens: np.ndarray, vocabulary: int) -> bytes:
    n, context = tokens.shape
    if tokens.size and (tokens.min() < 0 or tokens.max() > 0xFFFF):
        raise ValueError(f"token ids from {tokens.min()} to {tokens.max()} don't fit into 16 bits")
    return struct.pack(HEADER, MAGIC, VERSION, context, n, vocabulary) + tokens.astype("<u2").tobytes()


def read_header(data: bytes) -> tuple[int, int, int, int]:
    magic, version, context, n, vocabulary = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard of this version")
    return version, context, n, vocabulary


@dataclass
class Shards(InputPartition):
    paths: list[str]


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.headers = options["path"], options.get("headeronly", "false").lower() == "true"

    def partitions(self) -> list[Shards]:
        fs, path = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        out, held = [], 0
        for f in sorted((f for f in found if f.path.endswith(".bin")), key=lambda f: f.path):
            cost = OPEN_BYTES + (0 if self.headers else f.size or 0)
            if not out or held + cost > TASK_BYTES:
                out.append(Shards([]))
                held = 0
            out[-1].paths.append(f.path)
            held += cost
        return out

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        for path in partition.paths:
            yield from self.rows_of(fs, path)

    def rows_of(self, fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(path)
        with fs.open_input_stream(path) as f:
            version, context, n, vocabulary = read_header(f.read(struct.calcsize(HEADER)))
            if self.headers:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([context], pa.int32()), pa.array([n], pa.int64()), pa.array([vocabulary], pa.int64())], names=["shard", "version", "context", "sequences", "vocabulary"])
                return
            for begin in range(0, n, 1024):
                rows = min(1024, n - begin)
                values = np.frombuffer(f.read(rows * context * 2), "<u2").astype(np.int32)
                if len(values) != rows * context:
                    raise ValueError(f"{name} ends early")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, context), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(begin, begin + rows), pa.int64()), lists], names=["shard", "seq_id", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class TokenWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; only those of committed tasks get their final names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.vocabulary, self.most = int(options.get("vocabulary", 50_304)), int(options.get("sequencespershard", 131_072))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        files, held, n = [], [], 0

        def flush(least: int) -> None:
            """Write shards from what is held, and keep fewer rows than least; they are joined once."""
            nonlocal held, n
            rows, k = np.concatenate(held), 0
            while len(rows) - k >= least:
                name = f"{path}/.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(name) as f:
                    f.write(pack_shard(rows[k : k + self.most], self.vocabulary))
                files.append(name)
                k += self.most
            held, n = ([rows[k:].copy()], len(rows) - k) if k < len(rows) else ([], 0)

        for b in iterator:
            tokens = b.column(b.schema.get_field_index("tokens"))
            if not b.num_rows:
                continue
            rows = tokens.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            held.append(rows)
            n += len(rows)
            if n >= self.most:
                flush(self.most)
        if n:
            flush(1)
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = _fs(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.path.endswith(".bin"):
                    fs.delete_file(f.path)
        names = [f for m in messages if m for f in m.files]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda k: fs.move(names[k], f"{path}/train_{k:05d}.bin"), range(len(names))))

    def abort(self, messages: list) -> None:
        fs, _ = _fs(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(name)


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tkds"

    def schema(self) -> str:
        return HEADERS if self.options.get("headerOnly", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter({k.lower(): v for k, v in self.options.items()}, overwrite)
