"""What the operators of this subpackage share: staging, connected components, byte scans."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once (a longer document is one step).
CHUNK_BYTES = 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --- staging ---------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a local default is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("/tmp/checkpoints")
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Tables staged in each ``scratch`` that is open, innermost last.
_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged within are deleted at the end, unless staged with ``keep``."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def stage(df: DataFrame, name: str = "stage", keep: bool = False, **options) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: lineage ends there.

    The shuffle files that the write needed are no longer of use, so Spark drops them at its end.
    ``keep``: the table outlives the innermost ``scratch``, as far as the next one out.
    ``options``: of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for home in _scratches[-2:-1] if keep else _scratches[-1:]:
        home.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, **options)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with results (in any case)."""
    return df.drop(*(c for c in df.columns if c.lower() in names))


def unused(df: DataFrame, name: str) -> str:
    """A name for a passing column that ``df`` doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over ``edges`` (a, b: bigint): returns (node, root).

    Alternating large-star and small-star steps; ``root`` is the smallest node of the
    component.  Self loops and repeated edges are harmless, null ends are ignored.  Every round
    is written to the shared folder, so that lost executors cost one round at most.  Nothing is
    collected but one checksum a round.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with scratch(edges.sparkSession):
        e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before = mark(e)
        while before[0]:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            e = stage(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
            after = mark(e)
            if after == before:
                break
            before = after
        roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return stage(roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots", keep=True)


# --- texts as byte arrays --------------------------------------------------------------------

_U = np.uint64
#: ASCII white space: x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and those of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, _U)
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def stretch_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each stretch of bytes; stretches are in order and don't overlap.

    Each byte counts by a mixed value of itself and its place in the stretch, so that no regular
    sequence cancels out, as it does in polynomials modulo a power of two.
    """
    place = np.arange(len(text))
    from_ = np.zeros(len(text), np.int64)
    from_[begin] = begin
    place -= np.maximum.accumulate(from_) if len(text) else from_
    one, two = np.zeros(len(text) + 1, _U), np.zeros(len(text) + 1, _U)
    with np.errstate(over="ignore"):
        z = mix((place.view(_U) << _U(8) | text) + _U(_BASE))
        np.cumsum(z, out=one[1:], dtype=_U)
        np.cumsum((z ^ z >> _U(29)) * _U(0xD6E8FEB86659FD93), out=two[1:], dtype=_U)
        size = (end - begin).astype(_U)
        return mix(one[end] - one[begin] + size), mix((two[end] - two[begin]) ^ size)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return data, off


def joined(column: pa.ChunkedArray) -> bytes:
    """The values of a binary column one after the other."""
    parts = []
    for c in column.chunks:
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else [0, 0]
        parts.append(c.buffers()[2].to_pybytes()[off[0] : off[-1]] if off[-1] > off[0] else b"")
    return b"".join(parts)


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (i, j) of documents whose bytes together stay within ``most`` (one at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of documents i..j of a buffer, A-Z lower-cased.

    ``start``/``end``: byte places in ``low`` (the lower-cased bytes), ``doc``: number of the
    document from 0, ``hash``: 64-bit hash of each word's bytes, ``counts``: words a document.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int):
        self.low = low = LOWER[data[off[i] : off[j]]]
        self.off = o = off[i : j + 1] - off[i]
        n, docs = len(low), j - i
        black = ~SPACE[low]
        first, last = black.copy(), black.copy()
        if n:
            inner = o[(o > 0) & (o < n)]
            cut = np.zeros(n + 1, bool)
            cut[inner] = True
            first[1:] &= ~black[:-1] | cut[1:n]
            last[:-1] &= ~black[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(o, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=docs)
        self.hash = stretch_hashes(low, self.start, self.end)[0]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles and their documents; a shorter one's whole sequence."""
        h, doc, n = self.hash, self.doc, len(self.hash)
        if not n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total, full = h.copy(), np.ones(n, bool)
            for step in range(1, k):
                same = np.zeros(n, bool)
                same[: n - step] = doc[step:] == doc[: n - step]
                part = np.zeros(n, _U)
                part[: n - step] = mix(h[step:] + _U(step * 0x632BE59BD9B4E019 % (1 << 64)))
                total += np.where(same, part, _U(0))
                full &= same
        head = np.ones(n, bool)
        head[1:] = doc[1:] != doc[:-1]
        keep = full | (head & (self.counts[doc] < k))
        return mix(total[keep]), doc[keep]


class Lookup:
    """Open-addressing table from non-negative 63-bit keys to floats; load one half at most."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, (2 * len(key) - 1).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.key[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[slot[put]], self.value[slot[put]] = key[left[put]], value[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, known); the value of an unknown key is 0."""
        value, known = np.zeros(len(key), np.float32), np.zeros(len(key), bool)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            hit = self.key[slot] == key[left]
            value[left[hit]], known[left[hit]] = self.value[slot[hit]], True
            on = ~hit & (self.key[slot] >= 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return value, known
