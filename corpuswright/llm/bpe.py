"""Byte-level BPE encoding and decoding by recursive queries.

Each Python worker holds a DuckDB database with the vocabulary and its merge table. The words of a
partition's texts become token-position rows; a recursive query joins neighbouring positions with
the merge table and contracts, in every word at once, the leftmost pair of least rank, until no word
has a pair left. An ordered aggregation over the ids joined with the vocabulary gives the bytes back.
Only distinct words that the worker hasn't seen lately are queried; texts are joined from them.

A round of the recursion takes time in proportion to a word's length, so the work for one word grows
with its square. Words beyond LONG_WORD bytes (none in natural prose) go through a second recursive query
with the same result: where no token made by a contraction can take part in one of lower rank, a round
contracts all places of a word's least pair, from the left, and not just the first. It runs a bounded
number of rounds at a time, and again until no pair is left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces

LONG_WORD = 400
#: Bytes of words in one recursive query, and rows that one for long words may make.
QUERY_BYTES, QUERY_ROWS = 200_000, 1_000_000
MEMORY_MB = 300
#: Bytes of texts encoded at a time by a worker.
CHUNK_BYTES = 6_000_000
#: Words whose codes a worker keeps, twice as many at most.
WORDS = 400_000

#: A row is a token and its position, with the next position and token of its word. best: in each word,
#: the pair of least rank, leftmost among equals, and what follows its second token.
RECURSION = """
WITH RECURSIVE state(w, round, pos, nxt, tok, after) AS (
    SELECT w, 0, pos, pos + 1, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) FROM bytes
  UNION ALL
    SELECT s.w, s.round + 1, s.pos,
           CASE WHEN s.pos = best.spot THEN best.nxt ELSE s.nxt END,
           CASE WHEN s.pos = best.spot THEN best.fresh ELSE s.tok END,
           CASE WHEN s.pos = best.spot THEN best.after WHEN s.nxt = best.spot THEN best.fresh ELSE s.after END
    FROM (
        SELECT pair.*, gone.nxt, gone.after
        FROM (
            SELECT w, (min(key) & 4095)::INT AS spot, (min(key) >> 12 & 4095)::INT AS second, (min(key) >> 24)::INT AS fresh
            FROM (SELECT p.w, (m.new::BIGINT << 24) | (p.nxt::BIGINT << 12) | p.pos AS key FROM state p JOIN merges m ON m.l = p.tok AND m.r = p.after)
            GROUP BY w
        ) pair
        JOIN state gone ON gone.w = pair.w AND gone.pos = pair.second
    ) best
    JOIN state s ON s.w = best.w
    WHERE s.pos <> best.second
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) USING (w, round)
GROUP BY w
"""

#: all: what stands beside what. hits: places of each word's least pair. In a chain of hits that overlap, every
#: other one is taken, from the left; of a token that later contractions of lower rank may use, only the first hit.
LONG_RECURSION = """
WITH RECURSIVE state(w, round, pos, tok) AS (
    SELECT w, 0, pos, tok FROM bytes
  UNION ALL
    (WITH beside AS (
        SELECT w, round, pos, tok, lead(tok) OVER word AS after, lead(pos) OVER word AS nxt FROM state WHERE round < $most WINDOW word AS (PARTITION BY w ORDER BY pos)
    ), pairs AS (
        SELECT b.w, b.pos, b.nxt, m.new, m.lone FROM beside b JOIN merges m ON m.l = b.tok AND m.r = b.after
    ), hits AS (
        SELECT p.*, lag(p.nxt) OVER (PARTITION BY p.w ORDER BY p.pos) IS DISTINCT FROM p.pos AS starts, row_number() OVER (PARTITION BY p.w ORDER BY p.pos) AS number
        FROM pairs p JOIN (SELECT w, min(new) AS new FROM pairs GROUP BY w) least ON least.w = p.w AND least.new = p.new
    ), chained AS (
        SELECT *, max(CASE WHEN starts THEN number END) OVER (PARTITION BY w ORDER BY pos) AS chain FROM hits
    ), taken AS (
        SELECT w, pos, nxt, new FROM chained WHERE (number - chain) % 2 = 0 AND (number = 1 OR NOT lone)
    )
    SELECT b.w, b.round + 1, b.pos, coalesce(t.new, b.tok)
    FROM beside b LEFT JOIN taken t ON t.w = b.w AND t.pos = b.pos
    WHERE b.w IN (SELECT w FROM taken) AND NOT EXISTS (SELECT 1 FROM taken g WHERE g.w = b.w AND g.nxt = b.pos))
)
SELECT w, max(round) AS round, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) USING (w, round)
GROUP BY w
"""

DECODE = """
SELECT w, string_agg(v.hex, '' ORDER BY i) AS hex
FROM encoded JOIN vocabulary v USING (tok)
GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class WordEncoder:
    """Words (pre-tokens, as bytes) to ids and back."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.byte = np.array([ranks[bytes([v])] for v in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})  # nothing is left on a worker's disk
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, new = (pa.array(c, pa.int32()) for c in zip(*pairs, strict=True))
        # Tokens that take part in a contraction of lower rank than their own: there, one place at a time is contracted.
        lone = {part for l, r, n in pairs for part in (l, r) if n < part}
        merges = pa.table({"l": left, "r": right, "new": new, "lone": [n in lone for _, _, n in pairs]})  # noqa: F841  the queries name these tables
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS FROM vocabulary")

    def _recursive(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        self.con.register("bytes", pa.table({"w": w, "pos": pos, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        found = self.con.sql(RECURSION).to_arrow_table()
        self.con.unregister("bytes")
        ids = found.column("ids").combine_chunks()
        flat, cuts = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        out: list = [None] * len(words)
        for k, (i, j) in zip(found.column("w").to_pylist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True):
            out[k] = flat[i:j]
        return out

    def _recursive_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The same for long words, some rounds at a time."""
        state = [self.byte[np.frombuffer(x, np.uint8)] for x in words]
        open_ = list(range(len(words)))
        while open_:
            rows = sum(len(state[k]) for k in open_)
            most = max(1, QUERY_ROWS // rows)
            self.con.execute(f"SET memory_limit = '{max(MEMORY_MB, rows * 300 // 1_000_000)}MB'")  # one round of a huge word must fit
            pos = np.concatenate([np.arange(len(state[k]), dtype=np.int32) for k in open_])
            w = np.repeat(np.array(open_, np.int32), [len(state[k]) for k in open_])
            self.con.register("bytes", pa.table({"w": w, "pos": pos, "tok": np.concatenate([state[k] for k in open_])}))
            found = self.con.sql(LONG_RECURSION, params={"most": most}).to_arrow_table()
            self.con.unregister("bytes")
            open_ = []
            for k, rounds, ids in zip(found.column("w").to_pylist(), found.column("round").to_pylist(), found.column("ids"), strict=True):
                state[k] = ids.values.to_numpy().astype(np.int32)
                if rounds == most:
                    open_.append(k)
        return state

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct words. A word that is itself in the vocabulary is its id."""
        out: list = [np.array([r], np.int32) if (r := self.ranks.get(x)) is not None else np.zeros(0, np.int32) if not x else None for x in words]
        todo = [i for i, x in enumerate(out) if x is None]
        short, begin, size = [i for i in todo if len(words[i]) <= LONG_WORD], 0, 0
        for end, i in enumerate(short, 1):
            size += len(words[i])
            if size >= QUERY_BYTES or end == len(short):
                for k, ids in zip(short[begin:end], self._recursive([words[k] for k in short[begin:end]]), strict=True):
                    out[k] = ids
                begin, size = end, 0
        for i in (i for i in todo if len(words[i]) > LONG_WORD):  # one by one, as their states are large
            out[i] = self._recursive_long([words[i]])[0]
        return out

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation."""
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        flat = np.concatenate(encoded).astype(np.int32) if encoded else np.zeros(0, np.int32)
        w = np.repeat(np.arange(len(encoded), dtype=np.int32), sizes)
        self.con.register("encoded", pa.table({"w": w, "i": np.arange(len(w), dtype=np.int64), "tok": flat}))
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("encoded")
        out = [b""] * len(encoded)
        for k, x in zip(found.column("w").to_pylist(), found.column("hex").to_pylist(), strict=True):
            out[k] = bytes.fromhex(x)
        return out


def worker(path: str, pattern: str) -> pieces.Words:
    """Of this Python worker: text -> (ids, decoded bytes), by way of the words that match the pattern."""
    if (path, pattern) not in pieces._loaded:
        import regex

        find, coder = regex.compile(pattern).findall, WordEncoder(read_ranks(path))
        inner: dict[bytes, tuple[bytes, bytes]] = {}  # matches that make up a piece's word with others

        def encode(new: list[str]) -> list[tuple[bytes, bytes]]:
            found = [[w.encode() for w in find(x)] for x in new]
            unseen = [w for w in set(chain.from_iterable(found)) if w not in inner]
            ids = coder.encode(unseen)
            made = {}
            for word, x, text in zip(unseen, ids, coder.decode(ids), strict=True):
                made[word] = x.astype("<u4").tobytes(), word if text == word else text  # equal bytes are held once
            get = lambda w: made.get(w) or inner[w]
            values = [get(w[0]) if len(w) == 1 else tuple(map(b"".join, zip(*map(get, w), strict=True))) or (b"", b"") for w in found]
            several = {w: get(w) for w in set(chain.from_iterable(w for w in found if len(w) > 1))}
            if len(inner) + len(several) > WORDS:
                inner.clear()
            inner.update(several)
            return values

        pieces._loaded[path, pattern] = pieces.Words(encode, 2, WORDS)
    return pieces._loaded[path, pattern]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep, also ids (array<int>) and decoded (binary).

    A null text counts as empty: no ids. Rows that repeat a doc_id stay apart, null ones too. Texts and words of
    any length count whole. Other columns are ignored. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker(ranks_path, pattern)
        for b in batches:
            doc_ids = b.column(0)
            texts = b.column(1)
            for i, j in pieces.chunks(texts, CHUNK_BYTES):
                n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
                (ids, *ids_at), (text, *text_at) = coder.joined(texts.slice(i, j - i))
                for begin, end, first, last in zip(*ids_at, *text_at, strict=True):
                    n.append((end - begin) // 4)
                    ids_sha.append(hashlib.sha256(ids[begin:end]).hexdigest())
                    text_sha.append(hashlib.sha256(text[first:last]).hexdigest())
                    if keep:
                        all_ids.append(ids[begin:end].cast("I").tolist())
                        all_text.append(bytes(text[first:last]))
                columns = {"doc_id": doc_ids.slice(i, j - i), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if keep:
                    columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_text, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
