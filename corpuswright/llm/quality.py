"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear model on style and hashed words, by minimising the
non-negative unbiased risk: pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives)), with logistic
losses. The class prior pi is estimated from the mixture: above any margin lie at least pi times the
positives' share of texts, so that the least ratio of the two shares bounds it.

Features of all texts are written once. The unlabelled risk covers every training text: each pass sums
its value, gradient and Hessian over all of them, and the driver minimises the risk of the quadratic
that these give, with the positives themselves, before the next pass. Labels other than the trusted
positives are never used. At last two numbers, slope and shift, turn margins into probabilities, by the
same risk on the margins of all training texts and of the positives kept aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import pieces

#: Trusted positives that are fitted at most, those of least hash; each FIFTH one is kept for the prior.
MOST_POSITIVES, FIFTH = 6_000, 5
#: Passes over all texts, after how many of them the prior is estimated, steps between them, and how far these may go.
PASSES, PRIOR_AFTER, STEPS, REACH = 6, 3, 200, 2.0
#: Weight decay: the least, and what few positives need (over their number).
LEAST_DECAY, FEW_DECAY = 1e-3, 30.0
#: Share of positives that must lie above a margin for it to tell of the prior.
LEAST_ABOVE = 0.2
BINS, SPAN = 4096, 40.0
WORD_BUCKETS = 256
THRESHOLD = 0.3
#: Characters whose share of the text is a feature of its own.
SINGLE = "|#$%&*!?.,;:-_/\\<>{}[]()\"'=+@~^`"
STYLE = 16
SIZE = STYLE + len(SINGLE) + WORD_BUCKETS

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGIT = np.arange(ord("0"), ord("9") + 1)
_SINGLE = np.frombuffer(SINGLE.encode(), np.uint8)


def features(text: bytes, buckets: dict[bytes, int]) -> np.ndarray:
    """Of a whole text: shares of characters, lengths, repetition, hashed words. buckets: word -> bucket, kept by the caller."""
    import xxhash

    out = np.zeros(SIZE, np.float32)
    n = max(1, len(text))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    distinct = len(set(words))
    line_lengths = np.fromiter(map(len, lines), np.int32, len(lines)) if lines else np.zeros(1, np.int32)
    upper, lower = hist[_UPPER].sum(), hist[_LOWER].sum()
    out[:STYLE] = (
        upper, lower, hist[_DIGIT].sum(), hist[32], hist[10], hist[128:].sum(), upper / (upper + lower + 1e-6), np.log1p(len(text)) / 10,
        np.log1p(len(words)) / 10, lengths.mean() / 10, lengths.std() / 10, distinct / w, len(set(lines)) / max(1, len(lines)),
        np.log1p(line_lengths.mean()) / 10, (lengths == 1).mean(), np.log1p(len(lines)) / 10,
    )
    out[STYLE : STYLE + len(SINGLE)] = hist[_SINGLE] * 10
    if words:
        ids = [b if (b := buckets.get(x)) is not None else buckets.setdefault(x, xxhash.xxh32_intdigest(x) % WORD_BUCKETS) for x in words]
        if len(buckets) > 50_000:
            buckets.clear()
        out[STYLE + len(SINGLE) :] = np.sqrt(np.bincount(ids, minlength=WORD_BUCKETS) / w)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -SPAN, SPAN)))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    #: The last one is the bias.
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def constant(p: float) -> Model:
    """For want of positives or unlabelled text: every text has score p."""
    return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE + 1), 1.0, float(np.log(p / (1 - p))))


def minimised(w: np.ndarray, positive: np.ndarray, value: float, gradient: np.ndarray, hessian: np.ndarray, prior: float) -> np.ndarray:
    """Weights after STEPS steps of Adam on the non-negative risk. The unlabelled part (of loss log(1 + e^z)) is the
    quadratic around w of the given value, gradient and Hessian, trusted within REACH. Where the negative part
    falls below zero, its gradient is reversed, as non-negative learning prescribes."""
    decay = np.full(len(w), max(LEAST_DECAY, FEW_DECAY / len(positive)))
    decay[-1] = 0
    hessian = hessian + 1e-6 * np.eye(len(w))
    d, m, v = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z, bent = positive @ (w + d), hessian @ d
        negative = value + gradient @ d + d @ bent / 2 - prior * np.logaddexp(0, z).mean()
        up = -prior * (positive.T @ _sigmoid(-z)) / len(positive)
        down = gradient + bent - prior * (positive.T @ _sigmoid(z)) / len(positive)
        step = (up + down if negative >= 0 else -down) + decay * (w + d)
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        d = d - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        far = np.sqrt(max(0.0, d @ hessian @ d))
        d = d * (REACH / far) if far > REACH else d
    return w + d


def unlabelled_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of scaled rows, summed: a matrix of the Hessian, and below it the gradient, then the value and the number of rows."""
    z = x @ w
    s = _sigmoid(z)
    last = np.zeros((2, len(w)))
    last[0], last[1, 0], last[1, 1] = x.T @ s, np.logaddexp(0, z).sum(), len(x)
    return np.concatenate([(x * (s * (1 - s))[:, None]).T @ x, last])


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The least ratio of shares above a margin. Both are counts in BINS of rising margin."""
    above_u, above_p = (np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (unlabelled, positive))
    tell = above_p >= LEAST_ABOVE
    return float(np.clip((above_u[tell] / above_p[tell]).min(), 0.01, 0.99)) if tell.any() else 0.5


def _binned(z: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip((z + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64), minlength=BINS).astype(np.float64)


def calibrated(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that minimise the unbiased risk, by Newton steps. unlabelled: counts in BINS; positive: margins."""
    z, share = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN, unlabelled / unlabelled.sum()
    a, c = 1.0, 0.0
    for _ in range(100):
        s = _sigmoid(a * z + c)
        h = share * s * (1 - s)
        g = np.array([(share * s * z).sum() - prior * positive.mean() + 1e-3 * (a - 1), (share * s).sum() - prior])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), g)
        a, c = np.clip(np.array([a, c]) - np.clip(step, -1, 1), [1e-3, -SPAN], [20, SPAN])
    return float(a), float(c)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _matrix(texts: pa.Array, buckets: dict) -> np.ndarray:
    return np.stack([features(x.as_py() or b"", buckets) for x in texts]) if len(texts) else np.zeros((0, SIZE), np.float32)


def _stored(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float64)


def described(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (binary). Returns doc_id, held_out, x (features in half precision)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        buckets: dict = {}
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                x = _matrix(part.column(2), buckets).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, x binary")


def _summed(rows: DataFrame, height: int, width: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of add(features) over rows: a matrix of the given size. Tasks send one row for each row of the
    matrix; these are added up apart, in a fixed order, and reach the driver as one matrix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        total, some = np.zeros((height, width)), False
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                total += add(_stored(b.column(0).slice(k, 2000)))
                some = True
        if some:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(height, dtype=np.int32)), "task": pa.array([task] * height, pa.int32()), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(v, np.float64)
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(sums), pa.int32()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    parts = rows.select("x").mapInArrow(part, "i int, task int, v binary")
    found = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(whole, "i int, v binary").toArrow()  # height rows
    out = np.zeros((height, width))
    for i, v in zip(found.column("i").to_pylist(), found.column("v").to_pylist(), strict=True):
        out[i] = np.frombuffer(v, np.float64)
    return out


def positives(labels: DataFrame) -> DataFrame:
    """doc_id of trusted positives outside the held-out rows. Labels that are null, or that contradict each other, are none."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    return known.where("low = 1 AND high = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVES)


def train(feats: DataFrame, labels: DataFrame) -> Model:
    """feats: as described() returns them, written; labels: doc_id, quality. Labels of held-out rows are never read past the filter.

    Without a positive, or without unlabelled text, every score is 0.5. With fewer than FIFTH positives the
    prior is taken as a half."""
    free = feats.where("NOT held_out")
    trusted = feats.join(F.broadcast(positives(labels)), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow()  # MOST_POSITIVES rows
    if not trusted.num_rows:
        return constant(0.5)
    x = _stored(trusted.column("x"))[np.argsort(trusted.column("doc_id").to_numpy())]
    moments = _summed(free, 3, SIZE, lambda u: np.stack([u.sum(axis=0), (u**2).sum(axis=0), np.full(SIZE, float(len(u)))]))
    n = moments[2, 0]
    if not n:
        return constant(0.5)
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(0, moments[1] / n - mean**2)) + 1e-3, np.zeros(SIZE + 1))
    aside = np.arange(len(x)) % FIFTH == FIFTH - 1
    fitted, kept = model.scaled(x[~aside]), x[aside]
    prior, size = 0.5, SIZE + 1
    for k in range(PASSES):
        if k == PRIOR_AFTER and len(kept):
            prior = prior_of(_margins(free, model), _binned(model.margin(kept)))
        shared = free.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the input
        sums = _summed(free, size + 2, size, lambda u, m=shared: unlabelled_sums(m.value.scaled(u), m.value.weights)) / n
        model = model._replace(weights=minimised(model.weights, fitted, sums[-1, 0], sums[-2], sums[:-2], prior))
        shared.unpersist()
    if not len(kept):
        return model
    margins, apart = _margins(free, model), model.margin(kept)
    slope, shift = calibrated(margins, apart, prior_of(margins, _binned(apart)))
    return model._replace(slope=slope, shift=shift)


def _margins(rows: DataFrame, model: Model) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return _summed(rows, 1, BINS, lambda u: _binned(shared.value.margin(u))[None])[0]


def _inputs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Model]:
    text = F.col(text_col).cast("string").cast("binary")
    feats = tables.written(described(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))), "features")
    return feats, train(feats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1; higher: quality 1 likelier), predicted (score >= THRESHOLD).

    A null text is scored as an empty one. Rows that repeat a doc_id are scored each by its own text; as
    positives they count once. A null doc_id is not held out. Texts of any length count whole. Other columns
    are ignored. An empty table gives no rows."""
    feats, model = _inputs(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                score = pa.array(shared.value.score(_stored(part.column(2))), pa.float64())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "score": score})

    rows = feats.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns.

    A null text is judged as an empty one; rows with a null or repeated doc_id each by their own text. Texts of
    any length count whole. Without labels all rows stay; an empty table gives no rows."""
    feats, model = _inputs(docs, labels, "doc_id", "text")
    tables.drop(feats)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the input

    # Only texts go to the workers, and only scores come back; the rows themselves stay where they are.
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces.forget()
        buckets, m = {}, shared.value
        for texts in batches:
            x = (np.stack([features(v or b"", buckets) for v in texts.iloc[k : k + 250]]) for k in range(0, len(texts), 250))
            out = [m.score(v.astype(np.float16).astype(np.float64)) for v in x]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score(F.col("text").cast("string").cast("binary")) >= THRESHOLD)
