"""Near duplicates by an LSH forest of MinHash signatures, with every link confirmed on full sets.

1. Each text becomes a set of word shingles, and the set a signature of HASHES minima. Texts of equal
   sets are one node from then on, so groups of copies never meet in pairs.
2. TREES sorted orders: in each, a node stands under the hash of LEAST_DEPTH minima (its region), and
   within the region in the order of further minima. Candidates are the neighbours of longest common
   prefix: the NEIGHBOURS that follow in sorted order within the region. In a region of up to
   NEIGHBOURS + 1 nodes that is every pair; the nodes of larger ones are crowded. The order is dealt
   out by range, so a large region spreads over tasks; those at the ends of a task count as crowded.
3. Sketches of the signatures drop candidates that can't reach the threshold; of the others each node's
   best is confirmed first, on the full sets. Then those that still join different components are.
4. Crowded nodes, whose regions no further minima tell apart, meet once more in an exact join: of shingles
   in order of rarity, the first that two similar sets share stands among the first 11 % of the smaller
   one's and the first 20 % of the larger one's. Only those of the smaller ones are looked for among the
   others, so that a passage which a family shares makes no pairs unless it is most of a text.
   Pairs of different components only are made and confirmed.
5. Components of confirmed links.

A link between texts of similarity 0.8 shares no region with probability (1 - 0.8^4)^24, 3 in a
million; one that shares a region is found there or by the exact join. The sketches' floor lies 4.4
standard deviations below for the pairs of step 2. A lost link matters only if no other path ties its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import graph, pieces

TREES = 24
LEAST_DEPTH = 4
HASHES = TREES * LEAST_DEPTH
NEIGHBOURS = 3
#: Candidates whose sketches agree less can't be links: 4.4 standard deviations below 0.8.
SKETCH_FLOOR = 0.62
#: Counters that tell common shingles from rare ones. Any order is exact; one by rarity makes fewer pairs.
COUNTERS = 1 << 20

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
#: Minima that order a tree below its least depth: other trees' ones.
_DEEPER = np.stack([_rng.permutation(np.setdiff1d(np.arange(HASHES), np.arange(t * LEAST_DEPTH, (t + 1) * LEAST_DEPTH)))[:4] for t in range(TREES)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> set:
    """Exact shingles, for confirmation. Fewer words than width: the whole sequence as one."""
    w = words_of(text)
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    import xxhash

    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    width = min(width, len(w))
    n = len(w) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, (x[k : k + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hi and set_lo (the set's own hash), sketch, region and deeper (of each tree)."""
    schema = "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, sketch binary, region array<long>, deeper array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        pieces.forget()
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                n, hi, lo, m = [], [], [], np.empty((part.num_rows, HASHES), np.uint32)
                for i, text in enumerate(part.column(2)):
                    s = shingle_hashes(text.as_py() or b"", width)
                    n.append(len(s))
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    hi.append(int.from_bytes(d[:8], "little", signed=True))
                    lo.append(int.from_bytes(d[8:], "little", signed=True))
                    m[i] = _minima(s)
                region = np.arange(1, TREES + 1, dtype=np.uint64)[None, :].repeat(len(m), 0)
                for j in range(LEAST_DEPTH):
                    region = _mix(region * np.uint64(0x9E3779B97F4A7C15) + m[:, j::LEAST_DEPTH])
                deeper = np.zeros((len(m), TREES), np.uint64)
                for j in range(4):
                    deeper = deeper << np.uint64(16) | (_mix(m[:, _DEEPER[:, j]].astype(np.uint64)) & np.uint64(0xFFFF))
                offsets = pa.array(np.arange(0, (len(m) + 1) * TREES, TREES, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64).ravel())) for x in (region, deeper)]
                sketch = pa.array([row.tobytes() for row in (m & 0xFF).astype(np.uint8)], pa.binary())
                columns = [part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (n, hi, lo)), sketch, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "sketch", "region", "deeper"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, schema)


def _neighbours(nodes: DataFrame) -> DataFrame:
    """a, b: nodes that follow each other within a region of some tree; and each crowded node with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = [np.zeros(0, np.int64)] * 2, None
        for b in batches:
            if not b.num_rows:
                continue
            region, node = (np.concatenate([x, b.column(i).to_numpy()]) for x, i in zip(last, (0, 2), strict=True))
            seen, out = len(last[0]), []
            for d in range(1, NEIGHBOURS + 1):
                near = np.flatnonzero((region[d:] == region[:-d]) & (node[d:] != node[:-d]))
                near = near[near + d >= seen]  # pairs within the rows carried over came before
                out.append((node[near], node[near + d]))
            first = region[0] if first is None else first
            starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            held = np.diff(np.r_[starts, len(region)])
            crowded = node[np.repeat(held > NEIGHBOURS + 1, held) | (region == first)]
            out.append((crowded, crowded))
            last = [region[-NEIGHBOURS - 1 :], node[-NEIGHBOURS - 1 :]]
            a, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, c)), "b": pa.array(np.maximum(a, c))})
        # The last region may go on in the next task.
        end = last[1][last[0] == last[0][-1:]] if len(last[0]) else last[1]
        yield pa.RecordBatch.from_pydict({"a": pa.array(end), "b": pa.array(end)})

    rows = nodes.select(F.explode(F.arrays_zip("region", "deeper")).alias("t"), "node").select("t.region", "t.deeper", "node")
    # The order is total, so that every run deals the same rows to the same tasks.
    return rows.repartitionByRange("region", "deeper", "node").sortWithinPartitions("region", "deeper", "node").mapInArrow(run, "a long, b long").distinct()


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, near: pairs that may be links, by sizes and sketches."""
    one = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    floor = SKETCH_FLOOR - (0.8 - percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            near = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = near >= floor
            yield pa.RecordBatch.from_pydict({"a": pa.array(b.column(0).to_numpy()[keep]), "b": pa.array(b.column(1).to_numpy()[keep]), "near": pa.array(near[keep])})

    one, two = one.hint("merge"), two.hint("merge")
    fit = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return fit.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, near double")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. texts: node, text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                x, y = shingle_set(s.as_py(), width), shingle_set(t.as_py(), width)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(pa.array(keep, pa.bool_())), "b": b.column(1).filter(pa.array(keep, pa.bool_()))})

    # Texts are never broadcast, however few: the plan is the same at every size.
    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _ordered(text: bytes, width: int, common: np.ndarray) -> np.ndarray:
    """Shingles, rare ones first."""
    s = shingle_hashes(text, width)
    return s[np.lexsort((s, common[(s % np.uint64(COUNTERS)).astype(np.int64)]))]


def _counts(texts: DataFrame, width: int) -> np.ndarray:
    """COUNTERS numbers: how many texts hold shingles of each counter, single ones in a task aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, (shingle_hashes(t.as_py() or b"", width) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(n > 1)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    sums = texts.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int64)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out


def _prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """h, node, n (size of the set), at (place of h in order of rarity), indexed: the shingles among which two
    similar sets share one; indexed ones are those of the smaller set."""
    shared = texts.sparkSession.sparkContext.broadcast(_counts(texts, width))  # COUNTERS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [_ordered(t.as_py() or b"", width, shared.value) for t in part.column(1)]
                size = np.array([len(s) for s in sets], np.int64)
                probe = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                index = size - -(-2 * percent * size // (100 + percent)) + 1
                at = np.concatenate([np.arange(p) for p in probe])
                h = np.concatenate([s[:p] for s, p in zip(sets, probe, strict=True)]).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h), "node": pa.array(np.repeat(part.column(0).to_numpy(), probe)), "n": pa.array(np.repeat(size, probe).astype(np.int32)),
                    "at": pa.array(at.astype(np.int32)), "indexed": pa.array(at < np.repeat(index, probe)),
                })

    return texts.select("node", "text").mapInArrow(run, "h long, node long, n int, at int, indexed boolean")


def _prefix_pairs(texts: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: all pairs of nodes in different components that can reach the similarity, by prefixes of their
    shingles in one order. texts: node, text (binary). parts: node, component."""
    found = _prefixes(texts, width, percent).join(parts.hint("merge"), "node", "left")
    every = tables.written(found.withColumn("part", F.coalesce("component", "node")).drop("component"), "prefixes")
    # Shingles of one component, or that no smaller set is indexed by, make no pairs. Of the others, the largest component's rows never meet each other.
    held = every.groupBy("h", "part").agg(F.count(F.lit(1)).alias("k"), F.max("indexed").alias("indexed"))
    held = held.groupBy("h").agg(F.max_by("part", F.struct("k", "part")).alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("k"), F.max("indexed").alias("any"))
    held = tables.written(held.where("kinds > 1 AND any").select("h", "major", "k"), "held")
    rows = tables.looked_up(every, held, ["h"], "k", every.count(), ["node"]).where("major IS NOT NULL")
    rows = tables.written(rows, "shared")
    tables.drop(every, held)
    one, two = (rows.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "indexed", "part", "major")]) for x in "ab")
    one, two = one.where("indexed_a").drop("indexed_a"), two.drop("indexed_b", "major_b")
    # The smaller set comes first; it must be indexed by the shingle.
    smaller = F.struct("n_a", "node_a") < F.struct("n_b", "node_b")
    fits = F.col("n_a") * 100 >= F.col("n_b") * percent
    # Behind the first shared shingle, no more can be shared than either has left.
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = left * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    keep = smaller & fits & enough & (F.col("part_a") != F.col("part_b"))
    minor = one.where("part_a <> major_a").drop("major_a").hint("merge").join(two, "h").where(keep)
    major = one.where("part_a = major_a").hint("merge").join(two.withColumnRenamed("h", "h_b"), F.expr("h = h_b AND part_b <> major_a")).where(keep)
    pairs = minor.select("node_a", "node_b").unionByName(major.select("node_a", "node_b"))
    out = tables.written(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "pairs")
    tables.drop(rows)
    return out


def _united(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components of parts joined by further links. Both are given up."""
    if links.isEmpty():
        tables.drop(links)
        return parts
    out = graph.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    tables.drop(parts, links)
    return out


def _linked(sig: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """node, component: of nodes (one document for each distinct set) that have a link."""
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = sets.select("set_hi", "set_lo", F.col("node").alias("doc_id")).hint("merge")
    nodes = some.join(first, ["doc_id", "set_hi", "set_lo"], "left_semi").withColumnRenamed("doc_id", "node")
    nodes = tables.written(nodes.drop("text_hash").dropDuplicates(["node", "set_hi", "set_lo"]), "nodes")
    pairs = tables.written(_neighbours(nodes), "pairs")
    maybe = tables.written(_sketched(pairs.where("a <> b"), nodes, percent), "maybe")
    tables.drop(nodes)

    # Each node's best candidate is confirmed first.
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    best = maybe.select(F.explode(ends).alias("p"), "near").groupBy("p.x").agg(F.min_by("p.y", F.struct(-F.col("near"), F.col("p.y"))).alias("y"))
    best = tables.written(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "best")
    used = maybe.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("crowded"))
    used = used.union(pairs.where("a = b").select("a", F.lit(True))).groupBy("node").agg(F.max("crowded").alias("crowded"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts = tables.written(texts.join(used.hint("merge"), "node"), "texts")
    tables.drop(pairs)
    links = tables.written(confirmed(best, texts, width, percent), "links")
    parts = graph.components(links)
    tables.drop(links)

    # Whatever still joins different components is confirmed next; the rest can change nothing.
    one, two = (parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")).hint("merge") for c in "ab")
    rest = maybe.join(one, "a", "left").join(two, "b", "left").where("coalesce(part_a, a) <> coalesce(part_b, b)")
    rest = tables.written(rest.join(best.hint("merge"), ["a", "b"], "left_anti").select("a", "b"), "rest")
    tables.drop(maybe, best)
    parts = _united(parts, tables.written(confirmed(rest, texts, width, percent), "links"))
    tables.drop(rest)

    # Crowded regions hold pairs that are no neighbours.
    pairs = _prefix_pairs(texts.where("crowded"), parts, width, percent)
    parts = _united(parts, tables.written(confirmed(pairs, texts, width, percent), "links"))
    tables.drop(pairs, texts)
    return parts


def _placed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates() with text_hash, and the written tables that it reads."""
    sig = tables.written(signatures(docs, width, id_col, text_col), "signatures")
    sets = sig.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    sets = tables.written(sets, "sets")
    parts = _linked(sig, sets.where("node IS NOT NULL"), docs, width, percent, id_col, text_col)
    narrow = tables.written(sig.select("doc_id", "text_hash", "n_shingles", "set_hi", "set_lo"), "rows")
    tables.drop(sig)
    placed = sets.join(parts.hint("merge"), "node", "left").select("set_hi", "set_lo", "n", F.coalesce("component", "node").alias("component_id"))
    placed = tables.written(placed, "placed")
    tables.drop(sets, parts)
    # A group of copies of any size is dealt out: see looked_up.
    out = tables.looked_up(narrow, placed, ["set_hi", "set_lo"], "n", narrow.count(), ["doc_id", "text_hash"])
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), [narrow, placed]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Texts without a word (null ones too) have an empty set, link with nothing and are kept. Rows that
    repeat a doc_id are each placed by their own text. A row whose doc_id is null links with nothing,
    has component_id null and is kept. Families of texts that share most of a passage are told apart like
    any others. Texts of any length count whole. Other columns are ignored. An empty table gives no rows."""
    return _placed(docs, width, percent, id_col, text_col)[0].drop("text_hash")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stands for each component, with all their columns.

    Rows with a null doc_id or without a word stay. Rows that repeat a doc_id stay or go each by their own
    text; of those of one component one text stays. Rows that repeat both doc_id and text are one document,
    of which one row stays."""
    found, read = _placed(docs, width, percent, "doc_id", "text")
    found = tables.written(found.where("doc_id IS NOT NULL"), "found")
    tables.drop(*read)
    own = found.where("kept AND n_shingles > 0").groupBy("doc_id").agg(F.min("text_hash").alias("stays")).hint("merge")
    gone = found.where("n_shingles > 0").join(own, "doc_id", "left").where(~F.col("kept") | (F.col("text_hash") != F.col("stays")))
    gone = tables.written(gone.select("doc_id", "text_hash").distinct(), "gone")
    again = tables.written(found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "again")
    tables.drop(found)

    def listed(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).hint("merge")  # the plan is the same at every size
        same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
        return rows.join(ids, same, how)

    left = listed(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    return listed(left, again, "left_anti").unionByName(listed(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))
