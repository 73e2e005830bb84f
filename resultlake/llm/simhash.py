"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

A fingerprint is cut into segments of 23, 23 and 18 bits (the last padded to 23).  Two
fingerprints that differ in at most two bits have, by the pigeonhole principle, a pair of
segments with at most one differing bit between them: one segment equal, the other within one.
The binary Golay code [23, 12, 7] is perfect with radius 3, so every segment decodes to one
codeword within 3; all codewords within 4 (one or six) are its keys, and two segments within one
bit share a key.  A key is (pair, exact segment, codeword index of the other).  Fingerprints that
share a key are joined and verified by counting bits.

Buckets of more than ``BUCKET`` fingerprints are not paired: their members emit themselves and
their 64 one-bit neighbours; two fingerprints share such a point exactly if they differ in two
bits or fewer, and a point has at most 65 members, so this is exact and linear.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Buckets up to this size are joined pair by pair.
BUCKET = 8
SEED = 42
#: Longest run of shingles that 16-bit lane counters sum without overflow.
_LANE = 65_535
_U = np.uint64


def hash_bits(buf: np.ndarray, off: np.ndarray, width: int = 3) -> np.ndarray:
    """Fingerprints of the documents of one buffer (see ``fingerprints``)."""
    res = np.zeros(len(off) - 1, _U)
    for i, j in shared.chunks(off):
        w = shared.Words(buf, off, i, j)
        if not len(w.start):
            continue
        # words joined by one space each: black bytes and the first white byte after a word
        n = len(w.low)
        keep = np.zeros(n + 1, bool)
        black = np.zeros(n + 1, np.int32)
        black[w.start] += 1
        black[w.end] -= 1
        keep[:n] = np.cumsum(black)[:n] > 0
        length = w.end - w.start
        start = np.cumsum(length + 1) - (length + 1)
        text = np.full(int(start[-1] + length[-1]) + 1, 0x20, np.uint8)
        place = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
        text[place] = w.low[keep[:n]]
        end = start + length
        count = w.counts
        size = np.minimum(count, width)
        first = np.cumsum(count) - count
        shingles = np.where(count > 0, count - size + 1, 0)
        at = np.arange(int(shingles.sum())) + np.repeat(first - (np.cumsum(shingles) - shingles), shingles)
        to = at + np.repeat(size, shingles) - 1
        view, digest = memoryview(text.data), xxhash.xxh64_intdigest
        h = np.array([digest(view[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist(), strict=True)], _U)
        res[i:j] = _majority(h, shingles)
    return res


def _majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that over half of each run of ``sizes`` hashes have set; runs follow each other."""
    parts = np.where(sizes > 0, -(-sizes // _LANE), 0)
    owner = np.repeat(np.arange(len(sizes)), parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * _LANE
    bits = np.zeros(len(sizes), _U)
    if not len(begin):
        return bits
    for i in range(16):
        lanes = np.add.reduceat((h >> _U(i)) & _U(0x0001000100010001), begin)
        for lane in range(4):
            set_ = np.bincount(owner, ((lanes >> _U(16 * lane)) & _U(0xFFFF)).astype(np.float64), minlength=len(sizes))
            bits |= (2 * set_ > sizes).astype(_U) << _U(i + 16 * lane)
    return bits


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(``id_col``, fp bigint): 64-bit majority of the XXH64 of all ``width``-word shingles.

    A-Z is lower-cased, words are runs of non-white bytes, shingles are joined by one space and
    count as often as they occur.  Fewer words: the whole sequence; no words (also null or empty
    text): zero.  Rows with a null id keep it.
    """

    def run(batches):
        for b in batches:
            data, off = shared.buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hash_bits(data, off, width).view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


# --- Golay code ------------------------------------------------------------------------------

#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
N_BITS, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(N_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit; by remainder, the error patterns within radius 4.

    Six columns: the coset leader (weight 3 at most), then the five patterns of weight 4 that a
    leader of weight 3 has beside it (the leader again where it is lighter).
    """
    single = [_remainder(1 << k) for k in range(N_BITS)]
    near: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for bits in itertools.combinations(range(N_BITS), weight):
            s = 0
            for k in bits:
                s ^= single[k]
            near[s].append(sum(1 << k for k in bits))
    return np.array(single, np.int64), np.array([(x + [x[0]] * 6)[:6] for x in near], np.int64)


_single, _near = _tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices, 12 bits each, of the codewords within 4 bits of each 23-bit segment."""
    s = np.zeros(len(segment), np.int64)
    for k in range(N_BITS):
        s ^= np.where(segment >> k & 1, _single[k], 0)
    return (segment[:, None] ^ _near[s]) >> CHECK_BITS


def golay_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 36) keys of fingerprints; repeated where a segment has one codeword only."""
    u = fp.view(_U)
    seg = [((u >> _U(at)) & _U((1 << n) - 1)).astype(np.int64) for at, n in ((0, 23), (23, 23), (46, 18))]
    code = [codewords(s) for s in seg]
    pairs = [(x, y) for x in range(3) for y in range(3) if x != y]
    return np.concatenate([(tag << 35) | (seg[x][:, None] << 12) | code[y] for tag, (x, y) in enumerate(pairs)], axis=1)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` differing in 2 bits or fewer."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            keys = np.sort(golay_keys(fp), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, new.sum(1))), pa.array(keys[new])], ["fp", "key"])

    keys = shared.stage(fps.select("fp").mapInArrow(run, "fp bigint, key bigint"), "golay")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # ids of keys differ, so a pair may come from several buckets: made distinct before it is verified
    small = keys.join(sizes.where(F.col("n") <= bucket), "key")
    lists = small.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = lists.select(F.explode(F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*")
    large = keys.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    points = large.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))).alias("point"))
    around = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(``id_col``, fp bigint, component_id): documents whose fingerprints link, by component.

    ``component_id`` is the smallest id that links reach, the row's own included; null ids never
    lead a component.  One row for each input row, also for repeated and empty ones; an empty
    table gives none.
    """
    fp = shared.stage(fingerprints(docs, text_col, id_col, width), "simhash")
    lead = fp.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = shared.components(links(lead))
    named = lead.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = shared.stage(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-of")
    return fp.join(of, "fp").select(id_col, "fp", "component_id")


def distinct(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """The rows of ``docs`` with the least id (null last, then hash) of each component; columns stay.

    Rows that repeat id and text give one.
    """
    key = shared.unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    of = near_duplicates(keyed.select(key, text_col), text_col, key, width).select(key, "component_id").distinct()
    ranked = keyed.select(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("at")).distinct()
    least = ranked.join(of, key).groupBy("component_id").agg(F.min("at").alias("at"))
    keys = shared.stage(least.select(F.col("at.key").alias(key)), "simhash-kept")
    return keyed.join(keys, key, "left_semi").dropDuplicates([key]).drop(key)
