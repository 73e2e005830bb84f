"""Toxicity by a bidirectional gated recurrent network over character and word inputs.

Each word enters as its evidence (log odds of the label over hashed words), a trained word
embedding and the mean of trained embeddings of its character trigrams.  Two gated recurrent
layers read every window of ``WINDOW`` words, one from either side, attention pools their states,
and a logistic unit gives the window's probability.  Windows start every ``STRIDE`` words, so all
words but the outermost lie in two; a text's score is its most toxic window's.  Trained in numpy
on ``SAMPLE`` labelled texts at most (a stated bound: those with the least hash of
the id); everything else reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import small

WINDOW, STRIDE = 24, 12
UNITS, WORD_DIM, CHAR_DIM = 6, 3, 4
EVIDENCE_BUCKETS, WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 14, 1 << 12
#: Bound of the labelled sample that the network is fitted on.
SAMPLE = 12_000
#: Rounds of training; before each, every text of the sample adds the window that then scores highest.
ROUNDS, EPOCHS, BATCH, RATE = 3, 6, 512, 0.01
#: Most labels that are broadcast.
KNOWN_ROWS = 1_000_000
#: Least number of steps, for samples of few windows.
STEPS = 300
#: Weight of the base rate against what is seen of a word.
PRIOR = 4.0
_U = np.uint64


def _trigrams(w: shared.Words) -> np.ndarray:
    """Bucket of the byte trigram around each byte; a blank stands for what is outside its word."""
    before, here, after = np.full(len(w.low), 0x20, np.int64), w.low.astype(np.int64), np.full(len(w.low), 0x20, np.int64)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[w.start], after[w.end - 1] = 0x20, 0x20
    return ((before * 961 + here * 31 + after) * 0x9E3779B1 >> 7) & (CHAR_BUCKETS - 1)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((w, WINDOW) word numbers, -1 beyond a text's end; document of each window)."""
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    last = np.maximum(0, counts - WINDOW)[doc]
    begin = np.minimum(nth * STRIDE, last)
    at = begin[:, None] + np.arange(WINDOW)
    first = (np.cumsum(counts) - counts)[doc]
    return np.where(at < counts[doc][:, None], at + first[:, None], -1), doc


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _start(rng) -> dict[str, np.ndarray]:
    dim = 1 + WORD_DIM + CHAR_DIM
    p = {"E": np.zeros((WORD_BUCKETS, WORD_DIM)), "C": np.zeros((CHAR_BUCKETS, CHAR_DIM))}  # what training never met says nothing
    for side in "fb":
        p |= {f"W{side}": rng.normal(0, 0.4, (dim, 3 * UNITS)), f"U{side}": rng.normal(0, 0.3, (UNITS, 3 * UNITS)), f"b{side}": np.zeros(3 * UNITS), f"a{side}": rng.normal(0, 0.5, UNITS), f"o{side}": rng.normal(0, 0.5, UNITS)}
    return {k: v.astype(np.float32) for k, v in (p | {"c": np.full(1, -1.0)}).items()}


def _forward(p, gates, mask, keep=False):
    """Logits of windows; gates: {side: function of a step giving (w, 3 UNITS) inputs}."""
    n, steps = mask.shape
    states, saved = {}, {}
    for side in "fb":
        h = np.zeros((n, UNITS), np.float32)
        hs = states[side] = np.empty((steps, n, UNITS), np.float32)
        kept = saved[side] = [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g, u = gates(side, t), h @ p[f"U{side}"]
            zr = _sigmoid(g[:, : 2 * UNITS] + u[:, : 2 * UNITS])
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            c = np.tanh(g[:, 2 * UNITS :] + r * u[:, 2 * UNITS :])
            new = c + z * (h - c)
            m = mask[:, t, None]
            if keep:
                kept[t] = (h, z, r, c, u[:, 2 * UNITS :])
            h = hs[t] = np.where(m, new, h)
    e = (states["f"] @ p["af"] + states["b"] @ p["ab"]).T
    e = np.where(mask, e, -1e9)
    w = np.exp(e - e.max(1, keepdims=True)) * mask
    w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
    pooled = {s: np.einsum("nt,tnu->nu", w, states[s]) for s in "fb"}
    logit = pooled["f"] @ p["of"] + pooled["b"] @ p["ob"] + p["c"][0]
    return logit, (states, saved, w, pooled)


def _gradient(p, x, mask, label):
    """Gradients of the mean log loss; x: (w, WINDOW, dim) inputs."""
    g_in = {s: x @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}
    logit, (states, saved, w, pooled) = _forward(p, lambda s, t: g_in[s][:, t], mask, keep=True)
    d = (_sigmoid(logit) - label) / len(label)
    out = {"c": np.array([d.sum()], np.float32)}
    dx = np.zeros_like(x)
    value = states["f"] @ p["of"] + states["b"] @ p["ob"]  # (t, n)
    centre = (w.T * value).sum(0)
    de = d * w.T * (value - centre)  # (t, n)
    for s in "fb":
        out[f"o{s}"] = d @ pooled[s]
        out[f"a{s}"] = np.einsum("tn,tnu->u", de, states[s])
        up = (d * w.T)[:, :, None] * p[f"o{s}"] + de[:, :, None] * p[f"a{s}"]
        du_, dw_, db_ = np.zeros_like(p[f"U{s}"]), np.zeros_like(p[f"W{s}"]), np.zeros_like(p[f"b{s}"])
        dh = np.zeros((len(label), UNITS), np.float32)
        steps = mask.shape[1]
        for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
            h, z, r, c, uc = saved[s][t]
            m = mask[:, t, None]
            dh = dh + up[t]
            dn = np.where(m, dh, 0)
            dz = dn * (h - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * uc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            du_ += h.T @ du
            dw_ += x[:, t].T @ dg
            db_ += dg.sum(0)
            dx[:, t] += dg @ p[f"W{s}"].T
            dh = np.where(m, dn * z + du @ p[f"U{s}"].T, dh)
        out |= {f"U{s}": du_, f"W{s}": dw_, f"b{s}": db_}
    return out, dx


class Model:
    """Evidence by hashed word and the network's parameters; ``rate``: share of label 1."""

    def __init__(self, evidence, p, rate):
        self.evidence, self.p, self.rate = evidence, p, rate

    def word_inputs(self, w: shared.Words, evidence=None):
        """(n + 1, dim) inputs of words; the last row is the pad's."""
        n = len(w.start)
        x = np.zeros((n + 1, 1 + WORD_DIM + CHAR_DIM), np.float32)
        if n:
            x[:n, 0] = (self.evidence[_bucket(w)] if evidence is None else evidence) * 0.5
            x[:n, 1 : 1 + WORD_DIM] = self.p["E"][(w.hash & _U(WORD_BUCKETS - 1)).astype(np.int64)]
            sums = np.zeros((len(w.low) + 1, CHAR_DIM))
            np.cumsum(self.p["C"][_trigrams(w)], axis=0, dtype=np.float64, out=sums[1:])
            x[:n, 1 + WORD_DIM :] = (sums[w.end] - sums[w.start]) / (w.end - w.start)[:, None]
        return x

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each text of a buffer; a text without words has the base rate."""
        res = np.full(len(off) - 1, min(self.rate, 0.49))
        if self.p is None:
            return res
        for i, j in shared.chunks(off):
            w = shared.Words(data, off, i, j)
            if not len(w.start):
                continue
            x = self.word_inputs(w)
            g = {s: x @ self.p[f"W{s}"] + self.p[f"b{s}"] for s in "fb"}
            at, doc = windows(w.counts)
            best = np.full(j - i, -np.inf)
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                logit, _ = _forward(self.p, lambda s, t, part=part: g[s][part[:, t]], part >= 0)
                np.maximum.at(best, doc[k : k + 8192], logit)
            some = w.counts > 0
            res[i:j][some] = _sigmoid(best[some])
        return res


def _bucket(w: shared.Words) -> np.ndarray:
    return (w.hash >> _U(40)).astype(np.int64) & (EVIDENCE_BUCKETS - 1)


def _log_odds(a, b, rate):
    """Evidence of a word that a toxic and b other texts have, against the base rate."""
    return (np.log((a + PRIOR * rate) / (b + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))).astype(np.float32)


def _seen(batches):
    """Rows (bucket, a, b): texts of either label that have a word of the bucket; the last one: all texts."""
    a, b = (np.zeros(EVIDENCE_BUCKETS + 1, np.int64) for _ in "ab")
    for batch in batches:
        data, off = shared.buffers(batch.column(0))
        y = batch.column(1).to_numpy() == 1
        a[-1] += y.sum()
        b[-1] += (~y).sum()
        for i, j in shared.chunks(off):
            w = shared.Words(data, off, i, j)
            pair = np.unique(w.doc * EVIDENCE_BUCKETS + _bucket(w))
            yes = y[i:j][pair // EVIDENCE_BUCKETS]
            a[:-1] += np.bincount(pair[yes] % EVIDENCE_BUCKETS, minlength=EVIDENCE_BUCKETS)
            b[:-1] += np.bincount(pair[~yes] % EVIDENCE_BUCKETS, minlength=EVIDENCE_BUCKETS)
    used = np.flatnonzero(a + b)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(a[used]), pa.array(b[used])], ["bucket", "a", "b"])


_PICKED = ["rid", "label", "word", "ev", "size", "tri"]


def _picked(w: shared.Words, y: np.ndarray, a, b, rate, ids, p):
    """The window of each text that scores highest, under ``p`` or (None) by its words' evidence.

    A record batch of ids and labels; of the window's words hashes, evidence and sizes, and the
    trigrams of all their bytes.
    """
    own = y[w.doc].astype(np.int64)
    at_bucket = _bucket(w)
    # without the text itself: a word of one text only then says nothing
    e = _log_odds(a[at_bucket] - own, b[at_bucket] - (1 - own), rate)
    at, doc = windows(w.counts)
    if p is None:
        value = np.where(at >= 0, e[at], -9).max(1)
    else:
        x = Model(None, p, rate).word_inputs(w, e)
        g = {s: x @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}
        value = np.concatenate([_forward(p, lambda s, t, part=at[k : k + 8192]: g[s][part[:, t]], at[k : k + 8192] >= 0)[0] for k in range(0, len(at), 8192)])
    order = np.lexsort((np.arange(len(at)), -value, doc))
    take = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
    at, doc = at[take], doc[take]
    m = at >= 0
    size = np.where(m, w.end[at] - w.start[at], 0)
    flat = size[m]
    place = np.arange(int(flat.sum())) + np.repeat(w.start[at[m]] - (np.cumsum(flat) - flat), flat)
    tri = _trigrams(w)[place].astype(np.int16)
    edge = np.r_[0, np.cumsum(size.sum(1))]
    rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    columns = [pa.array(ids[doc]), pa.array(y[doc].astype(np.int32)), rows(np.where(m, w.hash[at].view(np.int64), 0)), rows(np.where(m, e[at], 0).astype(np.float32)), rows(size.astype(np.int32)), pa.array([tri[s:t].tobytes() for s, t in zip(edge[:-1], edge[1:], strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _PICKED)


def _once(rows: pa.Table) -> pa.Table:
    """``rows`` in order; a window that is picked again counts once, with the larger label.

    Equal rows are neighbours once sorted, so that the driver holds few copies of them.
    """
    keys = ["rid", "word", "ev", "tri", "size"]
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in keys] + [("label", "descending")]))
    differs = np.zeros(max(len(rows) - 1, 0), bool)
    for c in keys:
        differs |= pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy()
    return rows if differs.all() else rows.filter(pa.array(np.r_[True, differs]))


class _Examples:
    """Training windows: word inputs are made as in scoring, from all trigrams of whole words."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        of = lambda name, kind: np.frombuffer(shared.joined(rows.column(name)), kind).reshape(len(rows), WINDOW)
        self.text, self.label = rows.column("rid").to_numpy(), rows.column("label").to_numpy().astype(np.float32)
        size = of("size", np.int32)
        self.mask = size > 0
        self.ev = (of("ev", np.float32) * 0.5)[..., None]
        tri = np.frombuffer(shared.joined(rows.column("tri")), np.int16)
        words, first, inverse = np.unique(of("word", np.int64)[self.mask], return_index=True, return_inverse=True)
        self.word = np.zeros(self.mask.shape, np.int64)
        self.word[self.mask] = inverse
        self.bucket = (words.view(_U) & _U(WORD_BUCKETS - 1)).astype(np.int64)
        flat = size[self.mask].astype(np.int64)
        begin, self.size = (np.cumsum(flat) - flat)[first], flat[first]
        self.off = np.cumsum(self.size) - self.size
        self.tri = tri[np.arange(int(self.size.sum())) + np.repeat(begin - self.off, self.size)].astype(np.int64)

    def _words(self, s):
        """Words of some windows: (numbers, where each stands, sizes, places of their trigrams)."""
        word, of = np.unique(self.word[s], return_inverse=True)
        size = self.size[word]
        first = np.cumsum(size) - size
        return word, of.reshape(-1), size, self.tri[np.arange(int(size.sum())) + np.repeat(self.off[word] - first, size)], first

    def inputs(self, p, s):
        word, of, size, tri, first = self._words(s)
        mean = np.add.reduceat(p["C"][tri], first, axis=0) / size[:, None]
        x = np.concatenate([self.ev[s], p["E"][self.bucket[self.word[s]]], mean[of].reshape(*self.mask[s].shape, CHAR_DIM)], 2).astype(np.float32)
        x[~self.mask[s]] = 0
        return x

    def gradients(self, s, dx):
        """Gradients of the word and trigram tables from those of the inputs."""
        dx = dx.copy()
        dx[~self.mask[s]] = 0
        word, of, size, tri, _ = self._words(s)
        bucket = self.bucket[self.word[s]].ravel()
        e = np.stack([np.bincount(bucket, dx[..., 1 + k].ravel(), WORD_BUCKETS) for k in range(WORD_DIM)], 1)
        each = [np.repeat(np.bincount(of, dx[..., 1 + WORD_DIM + k].ravel(), len(word)) / size, size) for k in range(CHAR_DIM)]
        return {"E": e, "C": np.stack([np.bincount(tri, v, CHAR_BUCKETS) for v in each], 1)}


def _loss(p, data: _Examples, at: np.ndarray) -> float:
    total = 0.0
    for k in range(0, len(at), 4096):
        s = at[k : k + 4096]
        x = data.inputs(p, s)
        g = {side: x @ p[f"W{side}"] + p[f"b{side}"] for side in "fb"}
        z = _forward(p, lambda side, t, g=g: g[side][:, t], data.mask[s])[0]
        total += float(np.logaddexp(0, np.where(data.label[s] == 1, -z, z)).sum())
    return total / max(len(at), 1)


def _learned(p, data: _Examples):
    """Adam on the mean log loss; the parameters of least loss on a fifth of the texts, held out."""
    aside = shared.mix(data.text.view(_U)) % _U(5) == 0
    if not aside.any() or not 0 < data.label[aside].mean() < 1:
        aside = np.zeros(len(aside), bool)
    learn, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    rng = np.random.Generator(np.random.PCG64(10))
    m1, m2, step = {}, {}, 0
    best = (_loss(p, data, held) if len(held) else np.inf), dict(p)
    each = -(-len(learn) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // (ROUNDS * each)))):
        order = learn[rng.permutation(len(learn))]
        for k in range(0, len(order), BATCH):
            s = order[k : k + BATCH]
            g, dx = _gradient(p, data.inputs(p, s), data.mask[s], data.label[s])
            g |= data.gradients(s, dx)
            step += 1
            for name, d in g.items():
                d = d + 1e-5 * p[name]
                m1[name] = 0.9 * m1.get(name, 0) + 0.1 * d
                m2[name] = 0.999 * m2.get(name, 0) + 0.001 * d * d
                p[name] = (p[name] - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        if len(held) and (loss := _loss(p, data, held)) < best[0]:
            best = loss, dict(p)
    return best[1] if len(held) else p


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Words' evidence from all labelled texts; the network from ``sample`` of them at most (least hash of the id).

    Rows without a label, id or match are left out; null texts count as empty, repeated rows each.
    Without texts of both labels (an empty table, say) every text gets the base rate.  As a text
    scores as its highest window does, that one is what training sees of each: by its words'
    evidence at first, then under the model of the round before.  Executors count words and pick
    windows; the driver gets evidence by bucket and ROUNDS windows of each sampled text at most.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(small(known, KNOWN_ROWS), id_col).select("text", "label")
    seen = rows.mapInArrow(_seen, "bucket bigint, a bigint, b bigint").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    a, b = (np.zeros(EVIDENCE_BUCKETS + 1, np.int64) for _ in "ab")
    a[seen["bucket"]], b[seen["bucket"]] = seen["a"], seen["b"]
    n, yes = int(a[-1] + b[-1]), int(a[-1])
    a, b, rate = a[:-1], b[:-1], (yes / n if n else 0.0)
    if rate in (0.0, 1.0):
        return Model(np.zeros(EVIDENCE_BUCKETS, np.float32), None, rate)
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    sampled = texts.join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col, "text").alias("rid"), "text", "label")
    sampled = shared.stage(sampled, "toxicity-sample")
    sc = docs.sparkSession.sparkContext
    counts = sc.broadcast((a.astype(np.int32), b.astype(np.int32)))
    p, got = None, None
    for _ in range(ROUNDS):
        now = sc.broadcast(p)

        def pick(batches, now=now):
            a, b = (c.astype(np.int64) for c in counts.value)
            for batch in batches:
                data, off = shared.buffers(batch.column(1))
                ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for i, j in shared.chunks(off):
                    w = shared.Words(data, off, i, j)
                    if len(w.start):
                        yield _picked(w, y[i:j], a, b, rate, ids[i:j], now.value)

        new = sampled.mapInArrow(pick, "rid bigint, label int, word binary, ev binary, size binary, tri binary").toArrow()
        every = new if got is None else pa.concat_tables([got, new])
        if not every.num_rows:
            return Model(np.zeros(EVIDENCE_BUCKETS, np.float32), None, rate)
        got = new = None
        got, every = _once(every), None
        pa.default_memory_pool().release_unused()
        p = _learned(_start(np.random.Generator(np.random.PCG64(9))) if p is None else p, _Examples(got))
    return Model(_log_odds(a, b, rate), p, rate)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1); all else, nulls and repeats too, as it was.

    A column of that name is replaced.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast((model.evidence, model.p, model.rate))
    docs = shared.without(docs, "toxicity")
    at = docs.columns.index(text_col)

    def run(batches):
        model = Model(*shared_model.value)
        for b in batches:
            scores = pa.array(model.scores(*shared.buffers(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "toxicity"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, toxicity double")
