"""LM scoring by context-tree weighting over bytes, beside an add-one word model.

A text is read as its tokens: A-Z lower-cased words, joined by one space each, and one end mark.
Every byte is coded as eight binary decisions.  Each decision node has a context tree over the
preceding ``DEPTH`` bytes with Krichevsky-Trofimov estimates; context-tree weighting mixes those
of all depths, with the weights that all training counts give.  A frozen model so has one log
probability for each gram (context and byte), and a text's score is the sum over its grams.

Counts of grams and words grow with the corpus and are never gathered in one place.  Trees are
weighted where their grams lie, dealt by the two nearest bytes, some contexts of two bytes at a
time; only sums by depth-1 node (2^16 at most) reach the driver, which adds depths 1 and 0.  For scoring, the most frequent ``HOT_GRAMS`` and
``HOT_WORDS`` at most are broadcast, all others are joined by key and summed by document.  Words
are identified by 64-bit hashes, grams by their bytes.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

DEPTH = 5
END = 0xFF  # no byte of UTF-8 text; also what precedes a text
#: Most grams and words whose values are broadcast (16 bytes each).
HOT_GRAMS, HOT_WORDS = 1 << 19, 1 << 18
#: A task hands on its counts when it holds this many, and weights grams of contexts so many at a time or more.
FLUSH = 1 << 19
_TWO = np.log(2.0)


def grams(w: shared.Words) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every byte and end of the texts of ``w``, and the place of each text's first.

    A gram has the byte in its low 8 bits, then the preceding ones from the nearest on.
    """
    docs, size = len(w.counts), w.end - w.start
    bare = w.counts == 0
    before = (np.cumsum(bare) - bare)[w.doc]  # lone end marks of texts without words
    at = np.cumsum(size + 1) - (size + 1) + before
    text = np.full(1 + int((size + 1).sum()) + int(bare.sum()), END, np.uint8)  # one mark before the first
    inner = np.ones(len(size), bool)
    inner[:-1] = w.doc[1:] != w.doc[:-1]
    text[1 + (at + size)[~inner]] = 0x20
    shift = np.repeat(at - (np.cumsum(size) - size), size)
    black = np.zeros(len(w.low) + 1, np.int32)
    black[w.start] += 1
    black[w.end] -= 1
    text[1 + np.arange(int(size.sum())) + shift] = w.low[np.cumsum(black[:-1]) > 0]
    n = len(text) - 1
    length = np.maximum(1, np.bincount(w.doc, size + 1, docs).astype(np.int64))
    start = np.cumsum(length) - length
    key = text[1:].astype(np.int64)
    for k in range(1, DEPTH + 1):
        c = np.full(n, END, np.int64)
        c[k - 1 :] = text[: n - k + 1]
        for q in range(k - 1):
            c[(start + q)[length > q]] = END
        key |= c << 8 * k
    return key, start


# --- context trees ---------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series at x + 8, carried back."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back = x.copy()
    for k in range(1, 8):
        back *= x + k
    return series - np.log(back)


def _block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _nodes(key: np.ndarray, count: np.ndarray, level: int):
    """For depths 2 to DEPTH: (id of each node, node of each gram, counts of 0 and 1)."""
    prefix = (key & 255) >> (8 - level)
    bit = (key & 255) >> (7 - level) & 1
    found = {}
    for d in range(2, DEPTH + 1):
        ids, of = np.unique((key >> 8 & ((1 << 8 * d) - 1)) << level | prefix, return_inverse=True)
        found[d] = ids, of, np.bincount(of, count * (1 - bit), len(ids)), np.bincount(of, count * bit, len(ids))
    return found, bit


def _weighted(found):
    """By depth: log weighted probability of each node, and the weight of its own estimate."""
    whole, pick = {DEPTH: _block(*found[DEPTH][2:])}, {}
    for d in range(DEPTH - 1, 1, -1):
        parent = np.empty(len(found[d + 1][0]), np.int64)
        parent[found[d + 1][1]] = found[d][1]
        own = _block(*found[d][2:])
        whole[d] = np.logaddexp(own, np.bincount(parent, whole[d + 1], len(own))) - _TWO
        pick[d] = np.exp(np.minimum(own - _TWO - whole[d], 0))
    return whole, pick


def _by_context(batches):
    """(keys, counts, table) of some whole contexts of two bytes each, from rows in order of ``pair``.

    Not more is held than half of FLUSH rows and those of one context.
    """
    held, rows = [], 0

    def made(t):
        return t.column("key").to_numpy(), t.column("n").to_numpy().astype(np.float64), t

    for b in batches:
        if not b.num_rows:
            continue
        pair = b.column(b.schema.get_field_index("pair")).to_numpy()
        if rows > FLUSH // 2:
            edge = int(np.searchsorted(pair, pair[0], side="right")) if pair[0] == last else 0
            if edge < len(pair):
                held.append(b.slice(0, edge))
                yield made(pa.Table.from_batches(held))
                held, rows, b = [], 0, b.slice(edge)
        held.append(b)
        rows += b.num_rows
        last = pair[-1]
    if held:
        yield made(pa.Table.from_batches(held))


def _depth2(batches):
    """Rows (level, node, whole, n0, n1) of the depth-2 nodes of the grams dealt here."""
    for key, count, _ in _by_context(batches):
        for level in range(8):
            found, _ = _nodes(key, count, level)
            ids, _, n0, n1 = found[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), level, np.int32)), pa.array(_parent(level, ids)), pa.array(_weighted(found)[0][2]), pa.array(n0), pa.array(n1)], ["level", "node", "whole", "n0", "n1"])


def _parent(level: int, node: np.ndarray) -> np.ndarray:
    """The depth-1 node of each depth-2 node."""
    return (node >> level & 255) << level | node & ((1 << level) - 1)


def _upper(level: int, ids1: np.ndarray, whole: np.ndarray, m0: np.ndarray, m1: np.ndarray):
    """(a, b) of each depth-1 node, from sums over its depth-2 nodes: depths 0 and 1 turn their probability p of a 1 into a + b p."""
    ids0, of0 = np.unique(ids1 & ((1 << level) - 1), return_inverse=True)
    own1 = _block(m0, m1)
    whole1 = np.logaddexp(own1, whole) - _TWO
    w1, p1 = np.exp(np.minimum(own1 - _TWO - whole1, 0)), (m1 + 0.5) / (m0 + m1 + 1)
    k0, k1 = np.bincount(of0, m0), np.bincount(of0, m1)
    own0 = _block(k0, k1)
    whole0 = np.logaddexp(own0, np.bincount(of0, whole1)) - _TWO
    w0, p0 = np.exp(np.minimum(own0 - _TWO - whole0, 0)), (k1 + 0.5) / (k0 + k1 + 1)
    return w0[of0] * p0[of0] + (1 - w0[of0]) * w1 * p1, (1 - w0[of0]) * (1 - w1)


def _log_probabilities(key, count, top) -> np.ndarray:
    """log10 probability of each gram's byte; top: by level (sorted depth-1 nodes, a, b)."""
    total = np.zeros(len(key))
    for level in range(8):
        found, bit = _nodes(key, count, level)
        _, pick = _weighted(found)
        _, of, n0, n1 = found[DEPTH]
        p = ((n1 + 0.5) / (n0 + n1 + 1))[of]
        for d in range(DEPTH - 1, 1, -1):
            _, of, n0, n1 = found[d]
            w = pick[d][of]
            p = w * ((n1 + 0.5) / (n0 + n1 + 1))[of] + (1 - w) * p
        ids, a, b = top[level]
        at = np.searchsorted(ids, _parent(level, found[2][0]))[found[2][1]]
        p = a[at] + b[at] * p
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


# --- tables of bounded size ------------------------------------------------------------------


def _hot(table: DataFrame, by: str, most: int):
    """Condition that holds for the rows of largest ``by``, ``most`` at most, from a histogram."""
    step = F.floor(F.log2(F.col(by).cast("double")) * 8)
    total, least = 0, 1 << 30
    for s in table.where(F.col(by) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += s["rows"]
        if total > most:
            break
        least = s["step"]
    return F.coalesce((F.col(by) > 0) & (step >= least), F.lit(False))


# --- counting --------------------------------------------------------------------------------

GRAM, WORD, TEXT = 0, 1, 2


class _Tally:
    """Sums of counts by key, kept small by merging."""

    def __init__(self):
        self.keys, self.held, self.merged = [], 0, 0

    def add(self, *columns):
        self.keys.append(columns)
        self.held += len(columns[0])

    def merge(self):
        key, *counts = (np.concatenate(c) for c in zip(*self.keys, strict=True))
        self.keys = []
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.keys = [(key[first], *(np.add.reduceat(c[order], first) for c in counts))]
        self.merged = self.held = len(first)
        return self.keys[0]


def _counted(batches):
    """Rows (kind, key, n, every): counts in training texts and in all."""
    tallies, texts = {GRAM: _Tally(), WORD: _Tally()}, 0

    def rows(kind, key, n, every):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.array(every)], ["kind", "key", "n", "every"])

    for b in batches:
        data, off = shared.buffers(b.column(0))
        train = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
        texts += int(train.sum())
        for i, j in shared.chunks(off):
            w = shared.Words(data, off, i, j)
            key, start = grams(w)
            learn = np.repeat(train[i:j], np.diff(np.r_[start, len(key)]))
            k, n = np.unique(key << 1 | learn, return_counts=True)
            tallies[GRAM].add(k >> 1, n * (k & 1), n)
            h = w.hash[train[i:j][w.doc]]
            if len(h):
                k, n = np.unique(h.view(np.int64), return_counts=True)
                tallies[WORD].add(k, n, n)
            for kind, t in tallies.items():  # after each chunk: a batch may hold millions of grams
                if t.held > FLUSH + t.merged:
                    t.merge()
                    if t.held > FLUSH:
                        yield rows(kind, *t.keys[0])
                        t.__init__()
    for kind, t in tallies.items():
        if t.keys:
            yield rows(kind, *t.merge())
    if texts:
        yield rows(TEXT, np.zeros(1, np.int64), np.array([texts]), np.array([texts]))


@dataclasses.dataclass
class Model:
    """``values`` (kind, key, value, known): what isn't hot; ``hot_*``: what is broadcast."""

    values: DataFrame
    hot_grams: tuple[np.ndarray, np.ndarray]
    hot_words: tuple[np.ndarray, np.ndarray]
    texts: int
    tokens: int
    distinct: int


def fit(docs: DataFrame, train=None, text_col: str = "text") -> Model:
    """Learns from the texts of ``docs`` where ``train`` holds (None: all), for scoring ``docs``.

    Null texts count as empty.  Grams of texts that aren't learned from are weighted too, so that
    scoring finds every gram of ``docs``.  Without training texts all bits are even.
    """
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    counted = docs.select(F.col(text_col).alias("text"), train.alias("train")).mapInArrow(_counted, "kind int, key bigint, n bigint, every bigint")
    counts = shared.stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "lm-counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()}
    texts = sums[TEXT]["n"] if TEXT in sums else 0
    words = (sums[WORD]["n"], sums[WORD]["different"]) if WORD in sums else (0, 0)

    of = counts.where(F.col("kind") == GRAM).select("key", "n", "every")
    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF)  # grams of a depth-2 node meet
    dealt = of.withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair")
    node = dealt.mapInArrow(_depth2, "level int, node bigint, whole double, n0 double, n1 double").groupBy("level", "node").agg(*(F.sum(c).alias(c) for c in ("whole", "n0", "n1"))).toPandas()
    top = []
    for level in range(8):
        t = node[node["level"] == level].sort_values("node")
        ids = t["node"].to_numpy(np.int64)
        a, b = _upper(level, ids, t["whole"].to_numpy(), t["n0"].to_numpy(), t["n1"].to_numpy()) if len(t) else (np.zeros(0), np.zeros(0))
        top.append((ids, a, b))
    upper = docs.sparkSession.sparkContext.broadcast(top)

    def weigh(batches):
        for key, count, t in _by_context(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), t.column("every").combine_chunks(), pa.array(_log_probabilities(key, count, upper.value))], ["key", "every", "value"])

    gram = shared.stage(dealt.mapInArrow(weigh, "key bigint, every bigint, value double"), "lm-values")
    word = counts.where(F.col("kind") == WORD).select("key", "n")
    hot_gram, hot_word = _hot(gram, "every", HOT_GRAMS), _hot(word, "n", HOT_WORDS)
    g = gram.where(hot_gram).select("key", "value").toPandas()
    w = word.where(hot_word).select("key", F.log10(F.col("n") + 1.0).alias("value")).toPandas()
    values = gram.where(~hot_gram).select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(word.where(~hot_word).select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value")))
    return Model(values, (g["key"].to_numpy(np.int64), g["value"].to_numpy()), (w["key"].to_numpy(np.int64), w["value"].to_numpy()), texts, words[0] + texts, words[1] + (texts > 0))


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, n_known, base_score, score, bits_per_byte) of every row.

    ``score``: log10 of the model's probability of the text.  ``base_score``: the add-one word
    model's over words and one end.  ``n_bytes``: coded bytes, the end included.  Null text counts
    as empty, an empty text has its end alone; repeated rows are scored each.  A gram that ``fit``
    never met counts as eight even bits.
    """
    sc = docs.sparkSession.sparkContext
    hot_word = np.argsort(model.hot_words[0])
    tables = sc.broadcast((shared.Lookup(*model.hot_grams), model.hot_words[0][hot_word], model.hot_words[1][hot_word]))
    names = ["rid", "kind", "key", "tf", "id", "words", "known", "logs", "score", "bytes"]

    def run(batches):
        gram, hot, hot_log = tables.value
        for b in batches:
            data, off = shared.buffers(b.column(2))
            ids = b.column(0).to_numpy()
            for i, j in shared.chunks(off):
                n = j - i
                w = shared.Words(data, off, i, j)
                key, start = grams(w)
                length = np.diff(np.r_[start, len(key)])
                value, found = gram.get(key)
                bits = np.add.reduceat(value.astype(np.float64), start)
                word, which = np.unique(w.hash.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(hot, word), max(len(hot) - 1, 0))
                known = hot[at] == word if len(hot) else np.zeros(len(word), bool)
                log_c = np.where(known, hot_log[at] if len(hot) else 0.0, 0.0)
                rid = ids[i:j]
                ints = lambda x: pa.array(np.asarray(x, np.int64))
                yield pa.RecordBatch.from_arrays([
                    ints(rid), pa.array(np.full(n, TEXT, np.int32)), ints(shared.mix(rid.view(np.uint64)).view(np.int64)), ints(np.zeros(n)), b.column(1).slice(i, n),
                    ints(w.counts), ints(np.bincount(w.doc, known[which], n)), pa.array(np.bincount(w.doc, log_c[which], n)), pa.array(bits), ints(length),
                ], names)
                rare = np.flatnonzero(~found)
                doc_of = np.searchsorted(start, rare, side="right") - 1
                for kind, doc, keys in ((GRAM, doc_of, key[rare]), (WORD, w.doc[~known[which]], w.hash[~known[which]].view(np.int64))):
                    if len(doc):
                        order = np.lexsort((keys, doc))
                        doc, keys = doc[order], keys[order]
                        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])
                        m = len(first)
                        none = [pa.nulls(m, t) for t in (b.column(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                        yield pa.RecordBatch.from_arrays([ints(rid[doc[first]]), pa.array(np.full(m, kind, np.int32)), ints(keys[first]), ints(np.diff(np.r_[first, len(doc)])), *none], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, f"rid bigint, kind int, key bigint, tf bigint, id {dict(docs.dtypes)[id_col]}, words bigint, known bigint, logs double, score double, bytes bigint")
    joined = parts.join(model.values, ["kind", "key"], "left")
    value = F.coalesce(F.col("tf") * F.col("value"), F.lit(0.0))
    summed = joined.groupBy("rid").agg(
        F.max("id").alias(id_col),
        F.sum("bytes").alias("n_bytes"),
        F.sum("words").alias("words"),
        (F.sum("known") + F.sum(F.when((F.col("kind") == WORD) & F.col("value").isNotNull(), F.col("tf")).otherwise(0))).alias("known"),
        (F.sum("logs") + F.sum(F.when(F.col("kind") == WORD, value).otherwise(0.0))).alias("logs"),
        (F.sum("score") + F.sum(F.when(F.col("kind") == GRAM, F.col("tf") * F.coalesce("value", F.lit(float(-8 * np.log10(2))))).otherwise(0.0))).alias("score"),
    )
    end, each = float(np.log10(model.texts + 1.0)), float(np.log10(model.tokens + model.distinct + 1.0))
    return summed.select(
        id_col, "n_bytes", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(model.texts > 0)).alias("n_known"),
        (F.col("logs") + end - (F.col("words") + 1) * each).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
