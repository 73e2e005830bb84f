"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every five-word shingle is hashed once; the top bits choose one of ``BINS`` bins, each bin keeps
its least remaining value.  An empty bin takes the value of the first filled bin along a fixed
pseudo-random order of its own (optimal densification: each empty bin draws independently).  The
low ``BITS`` bits of each bin are packed; likeness is the share of equal bins, corrected for the
``2^-BITS`` that agree by chance.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WORDS, BINS, BITS = 5, 256, 4
#: Documents that share a bucket of neighbouring ids, about; and the most buckets there are.
BUCKET_ROWS, MAX_BUCKETS = 64, 1 << 16
_U = np.uint64
#: For each bin its order of all bins; the seed fixes it for all time.
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(20240229)).random((BINS, BINS)), axis=1)


def signatures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, BINS) uint8 of BITS bits each, filled boolean) of the documents of a buffer."""
    n = len(off) - 1
    sig, filled = np.zeros((n, BINS), np.uint8), np.zeros(n, bool)
    for i, j in shared.chunks(off):
        h, doc = shared.Words(data, off, i, j).shingles(WORDS)
        if not len(h):
            continue
        empty = ~_U(0)
        least = np.full((j - i) * BINS, empty, _U)
        np.minimum.at(least, doc * BINS + (h >> _U(56)).astype(np.int64), h << _U(8))
        least = least.reshape(-1, BINS)
        there = least != empty
        some = there.any(1)
        d, b = np.nonzero(~there & some[:, None])
        for step in range(BINS):
            if not len(d):
                break
            from_ = _ORDER[b, step]
            hit = there[d, from_]
            least[d[hit], b[hit]] = least[d[hit], from_[hit]]
            d, b = d[~hit], b[~hit]
        sig[i:j] = (shared.mix(least) & _U((1 << BITS) - 1)).astype(np.uint8)
        sig[i:j][~some] = 0
        filled[i:j] = some
    return sig, filled


def packed(sig: np.ndarray, filled: np.ndarray) -> list[str]:
    """Lowercase hex, two bins a byte; empty for a text without words."""
    raw = (sig[:, ::2] << 4 | sig[:, 1::2]).astype(np.uint8)
    return [r.tobytes().hex() if f else "" for r, f in zip(raw, filled, strict=True)]


def likeness(a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Unbiased Jaccard estimates in 0..1; texts without words are like each other only."""
    chance = 2.0**-BITS
    est = ((a == b).mean(1) - chance) / (1 - chance)
    return np.where(fa & fb, np.clip(est, 0, 1), (fa == fb).astype(float))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, fingerprint string) of every row; null text counts as empty (fingerprint '')."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(*signatures(*shared.buffers(b.column(1)))), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fingerprint string").withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (bucket, extra, id, text) in which every row's successor by id is in its own bucket.

    Ids are cut into buckets at their quantiles; each bucket gets a copy (``extra``) of the row
    that follows its last one, which for the last bucket is the first row of all.  Only the
    buckets' least ids (``MAX_BUCKETS`` at most) come to the driver.  Null ids go last; ties go by text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce(F.col("id").cast("double"), F.lit(math.inf)).alias("place")
    n = rows.count()
    parts = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted({*(rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or [])} - {math.inf}) if parts > 1 else []
    placed = rows.withColumn("place", order).withColumn("at", F.lit(0))
    if cuts:
        placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="at", handleInvalid="keep").transform(placed.drop("at"))
    dealt = placed.select(F.col("at").cast("int").alias("bucket"), "id", "text")
    heads = sorted((r["bucket"], r["id"]) for r in dealt.groupBy("bucket").agg(F.min("id").alias("id")).collect())
    if not heads:
        return dealt.select("bucket", F.lit(False).alias("extra"), "id", "text")
    spark = docs.sparkSession
    after = spark.createDataFrame([(heads[k - 1][0], i) for k, (_, i) in enumerate(heads)], "bucket int, id bigint")
    extra = rows.join(F.broadcast(after), rows.id.eqNullSafe(after.id)).select("bucket", F.lit(True).alias("extra"), rows.id, "text")
    return dealt.select("bucket", F.lit(False).alias("extra"), "id", "text").unionByName(extra)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NEXT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to that and to the next text.

    The next document is the one with the next larger id (ties by text; null ids last; the last
    one's is the first; a lone document follows itself).  Columns as in ``_NEXT``.  Texts pass one
    shuffle, dealt by neighbouring ids.
    """

    def rows(batch, following):
        ids, texts, nexts = zip(*batch, strict=True)
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        own = signatures(*shared.buffers(pa.array([*texts, following], pa.large_string())))
        new = signatures(*shared.buffers(pa.array(changed, pa.large_string())))
        sig, there = own
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(packed(sig[:-1], there[:-1])), pa.array(packed(*new)),
            pa.array(likeness(sig[:-1], there[:-1], *new)), pa.array(likeness(sig[:-1], there[:-1], sig[1:], there[1:])),
        ], schema=_NEXT)

    def run(batches):
        run_of, size, last, bucket, done = [], 0, None, None, False
        for b in batches:
            for where, extra, id_, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != bucket:
                    last, bucket, done = None, where, False
                if done:
                    continue
                if last is not None:
                    run_of.append((*last, text))
                    size += len(text)
                    if size > shared.CHUNK_BYTES or extra:
                        yield rows(run_of, text)
                        run_of, size = [], 0
                last, done = (id_, text), extra

    dealt = in_order(docs, text_col, id_col)
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_last(), "text")
    return sorted_.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("doc_id", id_col)
