"""MPEG transport streams as a media column.

mux() writes a payload as one programme: a programme association table, a programme map table, and
one elementary stream of private data whose access units of UNIT bytes are grouped into PES packets.
Each PES packet carries a presentation timestamp, and its first transport packet is a random access
point with a clock reference. parse() reads the tables (and their CRC), follows the programme to its
elementary stream, checks the continuity counters of all packets with a payload, reassembles them and
returns timestamps with the byte offset and packet number of every random access point. These points are
stored in a column beside the stream, so that a reader can seek without parsing; reading checks them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables

UNIT = 576
PACKET = 188
BODY = PACKET - 4
PMT_PID, STREAM_PID = 0x100, 0x101
PRIVATE_DATA = 0x06
#: Ticks of the 90 kHz clock that one access unit lasts.
UNIT_TICKS = 90 * 12
#: Access units in one PES packet.
UNITS_PER_PES = 16


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    """A packet's payload: pointer, section, CRC, then filler."""
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), ident, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", crc32_mpeg(section))
    return (b"\0" + section).ljust(BODY, b"\xff")


def _packet(pid: int, payload: bytes) -> bytes:
    return struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + payload


TABLES = _packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000)))


def _stamp(mark: int, ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return struct.pack(">BHH", mark << 4 | (t >> 30) << 1 | 1, (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


def _pes(unit: int, data: bytes) -> bytes:
    length = 8 + len(data)
    return struct.pack(">IHBBB", 0x1BD, length if length < 65536 else 0, 0x84, 0x80, 5) + _stamp(2, unit * UNIT_TICKS) + data


def _first_field(unit: int, stuffing: int) -> bytes:
    """Adaptation field with random access flag and clock reference."""
    base = unit * UNIT_TICKS & 0x1FFFFFFFF
    return struct.pack(">BBIH", 7 + stuffing, 0x50, base >> 1, (base & 1) << 15 | 0x7E00) + b"\xff" * stuffing


def mux(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes."""
    out, counter, step = [TABLES], 0, UNIT * UNITS_PER_PES
    for begin in range(0, len(payload), step):
        unit = begin // UNIT
        pes = _pes(unit, payload[begin : begin + step])
        room = BODY - 8
        if len(pes) <= room:
            out.append(struct.pack(">BHB", 0x47, 0x4000 | STREAM_PID, 0x30 | counter) + _first_field(unit, room - len(pes)) + pes)
            counter = counter + 1 & 15
            continue
        out.append(struct.pack(">BHB", 0x47, 0x4000 | STREAM_PID, 0x30 | counter) + _first_field(unit, 0) + pes[:room])
        rest = pes[room:]
        full, left = divmod(len(rest), BODY)
        rows = np.empty((full, PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
        rows[:, 3] = 0x10 | (counter + 1 + np.arange(full)) & 15
        rows[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
        out.append(rows.tobytes())
        counter = counter + 1 + full & 15
        if left:
            pad = BODY - left
            field = b"\0" if pad == 1 else struct.pack(">BB", pad - 1, 0) + b"\xff" * (pad - 2)
            out.append(struct.pack(">BHB", 0x47, STREAM_PID, 0x30 | counter) + field + rest[full * BODY :])
            counter = counter + 1 & 15
    return b"".join(out)


def points_of(payload_bytes: int) -> list[tuple[int, int, int]]:
    """The random access points (packet number, payload offset, timestamp) of mux() on so many bytes."""
    out, packet = [], len(TABLES) // PACKET
    for begin in range(0, payload_bytes, UNIT * UNITS_PER_PES):
        out.append((packet, begin, begin // UNIT * UNIT_TICKS & 0x1FFFFFFFF))
        rest = min(UNIT * UNITS_PER_PES, payload_bytes - begin) + 14 - (BODY - 8)
        packet += 1 + max(0, -(-rest // BODY))
    return out


class Stream(NamedTuple):
    payload: bytes
    programmes: dict[int, int]
    streams: dict[int, int]
    discontinuities: int
    timestamps: list[int]
    #: (packet number, payload offset, timestamp) of each random access point
    access_points: list[tuple[int, int, int]]


def _read_section(payload: bytes, table_id: int) -> bytes:
    begin = 1 + payload[0]
    if payload[begin] != table_id:
        raise ValueError(f"table {payload[begin]} where {table_id} was due")
    end = begin + 3 + (struct.unpack_from(">H", payload, begin + 1)[0] & 0xFFF)
    if crc32_mpeg(payload[begin:end]):
        raise ValueError("a table's CRC is wrong")
    return payload[begin + 8 : end - 4]


def parse(media: bytes) -> Stream:
    """Raises ValueError for what isn't a whole stream of packets with intact tables."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("sync byte lost")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    body = lambda i: media[i * PACKET + 4 + (1 + media[i * PACKET + 4] if media[i * PACKET + 3] & 0x20 else 0) : (i + 1) * PACKET]
    tables = np.flatnonzero(pid == 0)
    if not len(tables):
        raise ValueError("no programme association table")
    pat = _read_section(body(int(tables[0])), 0)
    programmes = {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", pat) if n}
    streams: dict[int, int] = {}
    for map_pid in programmes.values():
        at = np.flatnonzero(pid == map_pid)
        if not len(at):
            raise ValueError("no programme map table")
        pmt = _read_section(body(int(at[0])), 2)
        k = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF)
        while k < len(pmt):
            kind, es, info = struct.unpack_from(">BHH", pmt, k)
            streams[es & 0x1FFF] = kind
            k += 5 + (info & 0xFFF)
    wanted = next((p for p, kind in streams.items() if kind == PRIVATE_DATA), None)
    if wanted is None:
        raise ValueError("no stream of private data")
    at = np.flatnonzero(pid == wanted)
    own = rows[at]
    counters = own[(own[:, 3] & 0x10) > 0, 3] & 15  # packets without a payload don't count on
    lost = int((((counters[1:].astype(int) - counters[:-1]) & 15) != 1).sum())
    has_field = (own[:, 3] & 0x20) > 0
    skip = np.where(has_field, own[:, 4].astype(int) + 1, 0)
    keep = np.arange(BODY)[None, :] >= skip[:, None]
    elementary = own[:, 4:][keep].tobytes()
    ends = np.cumsum(BODY - skip)
    begins = np.flatnonzero((own[:, 1] & 0x40) > 0)
    access = has_field & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    parts, stamps, points, offset = [], [], [], 0
    for n, i in enumerate(begins):
        begin = int(ends[i] - (BODY - skip[i]))
        end = int(ends[begins[n + 1] - 1]) if n + 1 < len(begins) else len(elementary)
        if elementary[begin : begin + 4] != b"\0\0\1\xbd":
            raise ValueError("a PES packet's start code is missing")
        length = struct.unpack_from(">H", elementary, begin + 4)[0]
        if length and begin + 6 + length != end:
            raise ValueError("a PES packet's length is wrong")
        a, b, c = struct.unpack_from(">BHH", elementary, begin + 9)
        ticks = (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1
        data = elementary[begin + 9 + elementary[begin + 8] : end]
        stamps.append(ticks)
        if access[i]:
            points.append((int(at[i]), offset, ticks))
        parts.append(data)
        offset += len(data)
    return Stream(b"".join(parts), programmes, streams, lost, stamps, points)


def seek(media: bytes, stream: Stream, ticks: int) -> tuple[int, int, int]:
    """The last random access point at or before a time."""
    return max((p for p in stream.access_points if p[2] <= ticks), default=stream.access_points[0])


#: Of each random access point.
POINTS = "array<struct<packet:long,offset:long,ticks:long>>"


def _point_column(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([p for row in rows for p in row], np.int64).reshape(-1, 3)
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    struct_ = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["packet", "offset", "ticks"])
    return pa.ListArray.from_arrays(pa.array(offsets), struct_)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, points: the text's UTF-8 bytes (null: none), padded with 255, as a stream, and
    its random access points.

    Rows with a null or repeated doc_id are streams of their own; equal texts give equal streams. Texts of any
    length count whole, as far as a cell holds them (2 GB). Other columns are ignored. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                data = [x or b"" for x in part.column(1).to_pylist()]
                padded = [x + b"\xff" * (-len(x) % UNIT or (0 if x else UNIT)) for x in data]
                columns = {"n_bytes": pa.array([len(x) for x in data], pa.int64()), "media": pa.array([mux(x) for x in padded], pa.binary()), "points": _point_column([points_of(len(x)) for x in padded])}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | columns)

    data = F.col(text_col).cast("string").cast("binary").alias("data")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), data).mapInArrow(run, f"doc_id long, n_bytes long, media binary, points {POINTS}")


def read_media(stored: DataFrame) -> DataFrame:
    """Parse stored streams: the features that depend on nothing but the stored bytes, and the random access points.

    feature: programme, stream type, packets, discontinuities, access points, last timestamp, and a
    crc32 of the access point table. Raises ValueError where the stored points aren't the stream's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                points = []
                for media in part.column(2).to_pylist():
                    s = parse(media)
                    points.append(s.access_points)
                    table = np.array(s.access_points, "<i8").tobytes()
                    rows["payload_bytes"].append(len(s.payload))
                    rows["payload_sha256"].append(hashlib.sha256(s.payload).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(s.payload[-32:]))
                    rows["media_bytes"].append(len(media))
                    rows["media_sha256"].append(hashlib.sha256(media).hexdigest())
                    kind = next(iter(s.streams.values()))
                    rows["feature"].append(f"programmes={len(s.programmes)};type={kind};packets={len(media) // PACKET};lost={s.discontinuities};points={len(s.access_points)};last={s.timestamps[-1]};table={zlib.crc32(table):08x}")
                found = _point_column(points)
                if found.to_pylist() != part.column(3).to_pylist():
                    raise ValueError("stored access points are not the stream's")
                types = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
                out = {"doc_id": part.column(0), "n_bytes": part.column(1)} | {c: pa.array(v, types.get(c, pa.string())) for c, v in rows.items()}
                yield pa.RecordBatch.from_pydict(out | {"points": found})

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points {POINTS}"
    return stored.select("doc_id", "n_bytes", "media", "points").mapInArrow(run, schema)


def write_and_read(docs: DataFrame) -> DataFrame:
    """read_media() of all documents, written and read back. Nulls, repeats and empty tables as in store_media()."""
    return read_media(tables.written(store_media(docs), "media"))
