"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All thresholds share one weight vector over hashed words and a few measures of shape, so
P(grade >= k) = sigmoid(w x - t_k) with t_1 < t_2 < ...; thresholds stay ordered because all but
the first are a sum of positive steps.  The expected grade is the sum of the tail probabilities.
Fitted in numpy on ``SAMPLE`` rated texts at most (a stated bound: those of least hash of the id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 16
SAMPLE = 12_000
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.05, 1e-4
_U = np.uint64
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"!?-()"]] = True
SHAPES = 10


def _per(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return sums[off[1:]] - sums[off[:-1]]


def shapes(w: shared.Words, raw: np.ndarray) -> np.ndarray:
    """(n, SHAPES) measures of whole texts: lengths, symbols, digits, capitals, repeats, lines."""
    o, n = w.off, np.diff(w.off)
    size = np.maximum(n, 1)
    count = np.maximum(w.counts, 1)
    symbols = _PUNCTUATION[raw] & ~_PLAIN[raw]
    lone = np.bincount(w.doc, (w.end - w.start == 1) & symbols[w.start], len(n))
    pair = np.unique(np.stack([w.doc.astype(_U), w.hash], 1), axis=0) if len(w.doc) else np.zeros((0, 2), _U)
    kinds = np.bincount(pair[:, 0].astype(np.int64), minlength=len(n))
    lines = _per(raw == 10, o) + 1
    return np.stack([
        np.log1p(w.counts), n / count, _per(symbols, o) / size * 10, _per(_PLAIN[raw], o) / size * 10, _per((raw >= 48) & (raw < 58), o) / size * 10,
        _per((raw >= 65) & (raw < 91), o) / size * 10, lone / count * 5, 1 - kinds / count, np.log1p(n / lines), _per(raw >= 128, o) / size * 5,
    ], 1).astype(np.float32)


class Model:
    """Weights of buckets and measures, their means and scales, and the thresholds."""

    def __init__(self, words, shape, mean, scale, thresholds):
        self.words, self.shape, self.mean, self.scale, self.thresholds = words, shape, mean, scale, thresholds

    def tails(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(n, grades - 1) probabilities of each grade or more."""
        z = np.zeros(len(off) - 1)
        for i, j in shared.chunks(off):
            w = shared.Words(data, off, i, j)
            sums = np.bincount(w.doc, self.words[(w.hash & _U(BUCKETS - 1)).astype(np.int64)], j - i)
            z[i:j] = sums / np.sqrt(np.maximum(w.counts, 1)) + ((shapes(w, data[off[i] : off[j]]) - self.mean) / self.scale) @ self.shape
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -30, 30)))


def _features(batches):
    """(rid, grade, bucket binary, share binary, shape binary) of rated texts."""
    for b in batches:
        data, off = shared.buffers(b.column(1))
        rid, grade = b.column(0).to_numpy(), b.column(2).to_numpy()
        for i, j in shared.chunks(off):
            w = shared.Words(data, off, i, j)
            shape = shapes(w, data[off[i] : off[j]])
            key, n = np.unique(w.doc * BUCKETS + (w.hash & _U(BUCKETS - 1)).astype(np.int64), return_counts=True)
            edge = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
            share = (n / np.sqrt(np.maximum(w.counts, 1))[key // BUCKETS]).astype(np.float32)
            bucket = (key % BUCKETS).astype(np.uint16)
            cut = lambda x, edge=edge: pa.array([x[s:t].tobytes() for s, t in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid[i:j]), pa.array(grade[i:j]), cut(bucket), cut(share), pa.array([r.tobytes() for r in shape], pa.binary())], ["rid", "grade", "bucket", "share", "shape"])


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on rated texts; rows without rating, id or match are left out, null texts are empty.

    Grades are whole numbers from 0; with fewer than two of them every tail is one half.
    """
    known = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(grade_col).cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    got = rows.select(F.xxhash64(id_col, "text"), "text", "grade").mapInArrow(_features, "rid bigint, grade int, bucket binary, share binary, shape binary").toPandas()
    got = got.sort_values(["rid", "bucket"], ignore_index=True)
    y = got["grade"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    grades = int(y.max()) + 1 if len(y) else 1
    if grades < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(SHAPES), np.zeros(SHAPES), np.ones(SHAPES), np.zeros(1))
    bucket = [np.frombuffer(x, np.uint16) for x in got["bucket"]]
    share = [np.frombuffer(x, np.float32) for x in got["share"]]
    shape = np.stack([np.frombuffer(x, np.float32) for x in got["shape"]])
    mean, scale = shape.mean(0), shape.std(0) + 1e-6
    shape = (shape - mean) / scale
    w, v = np.zeros(BUCKETS, np.float64), np.zeros(SHAPES)
    reach = (y[:, None] >= np.arange(1, grades)).mean(0)
    raw = np.zeros(grades - 1)  # first threshold, then logs of the steps
    start = -np.log(np.clip(reach, 1e-3, 1 - 1e-3) / (1 - np.clip(reach, 1e-3, 1 - 1e-3)))
    raw[0], raw[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    gw, gv, gr = np.full(BUCKETS, 1e-3), np.full(SHAPES, 1e-3), np.full(grades - 1, 1e-3)
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            s = order[k : k + BATCH]
            size = [len(bucket[i]) for i in s]
            at, x, doc = np.concatenate([bucket[i] for i in s]).astype(np.int64), np.concatenate([share[i] for i in s]), np.repeat(np.arange(len(s)), size)
            z = np.bincount(doc, w[at] * x, len(s)) + shape[s] @ v
            t = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
            tail = np.c_[np.ones(len(s)), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))), np.zeros(len(s))]
            p = np.maximum(tail[np.arange(len(s)), y[s]] - tail[np.arange(len(s)), y[s] + 1], 1e-9)
            slope = tail * (1 - tail)  # of each tail by z
            up, down = slope[np.arange(len(s)), y[s]], slope[np.arange(len(s)), y[s] + 1]
            dz = -(up - down) / p / len(s)
            dt = np.zeros(grades - 1)
            np.add.at(dt, np.maximum(y[s] - 1, 0), np.where(y[s] > 0, up / p, 0) / len(s))
            np.add.at(dt, np.minimum(y[s], grades - 2), np.where(y[s] < grades - 1, -down / p, 0) / len(s))
            g = np.bincount(at, dz[doc] * x, BUCKETS) + SHRINK * w
            h = dz @ shape[s] + SHRINK * v
            r = np.cumsum(dt[::-1])[::-1]
            r[1:] *= np.exp(raw[1:])
            for value, grad, seen in ((w, g, gw), (v, h, gv), (raw, r, gr)):
                seen += grad * grad
                value -= RATE * grad / np.sqrt(seen)
    return Model(w.astype(np.float32), v, mean, scale, np.cumsum(np.r_[raw[0], np.exp(raw[1:])]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade (double), tails (array<double>, grade 1 on) and grade (int).

    ``grade``: the highest one whose tail is one half or more.  Rows stay as they were; null texts
    count as empty; columns of these names are replaced.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(vars(model))
    docs = shared.without(docs, "expected_grade", "tails", "grade")
    at = docs.columns.index(text_col)

    def run(batches):
        model = Model(**shared_model.value)
        for b in batches:
            tails = model.tails(*shared.buffers(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array((tails >= 0.5).sum(1).astype(np.int32))], [*b.schema.names, "expected_grade", "tails", "grade"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, expected_grade double, tails array<double>, grade int")
