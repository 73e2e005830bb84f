"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are split by the pattern; every task counts its distinct pre-tokens, one shuffle by
   pre-token makes them globally distinct, and each is encoded once.
2. Pre-tokens explode with their positions and the ids join back.  The join treats its skew by
   splitting it: the ``HOT`` most frequent short pre-tokens, a table of bounded size, are
   broadcast and joined where the text lies; all others shuffle as (pre-token, text, positions), a pre-token by two independent hashes, 95
   bits in all.
3. Texts (as hot ranks) and joined ids meet by text and are reassembled by position.
Decoding joins the ids with the token-byte table, which the vocabulary bounds, and concatenates.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Pre-tokens that are broadcast: so many at most, and so many bytes each at most.
HOT, HOT_BYTES = 1 << 19, 32
#: A task hands on its pre-token counts when it holds this many.
FLUSH = 800_000


@cache
def pattern(text: str):
    import regex

    return regex.compile(text)


@cache
def encoding(ranks_path: str, pattern_text: str):
    """The tokenizer of a rank file (base64 token and rank a line), without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern_text, mergeable_ranks=ranks, special_tokens={})


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in order of id, and the offsets of each."""
    with open(ranks_path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    parts = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Joins ids with the token-byte table and concatenates; an unknown id raises IndexError."""
    data, off = table
    if not len(ids):
        return b""
    begin, size = off[ids], off[ids.astype(np.int64) + 1] - off[ids]
    place = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return data[place].tobytes()


#: Pattern that ``pretokens`` finds by array operations; others run as regular expressions.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE, _LETTER, _NUMBER, _OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's own engine sees it."""
    table = np.full(0x110000, _OTHER, np.uint8)
    kinds = [(kind, pattern(of)) for kind, of in ((_WHITE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"))]
    for base in range(0, 0x110000, 0x1000):  # in blocks, as a string of all code points is large
        if 0xD800 <= base < 0xE000:
            continue
        text = "".join(map(chr, range(base, base + 0x1000)))
        for kind, of in kinds:
            for m in of.finditer(text):
                table[base + m.start() : base + m.end()] = kind
    return table


def pretokens(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places in ``text`` where the matches of KNOWN_PATTERN begin; matches leave no gaps.

    ``text``: UTF-8 bytes of documents that end at ``off``; no match crosses documents.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    table = _classes()
    kind = table[:128][np.minimum(text, 127)]
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        b = np.zeros((4, len(lead)), np.int64)
        for k in range(4):
            b[k] = text[np.minimum(lead + k, n - 1)]
        size = np.where(b[0] >= 0xF0, 4, np.where(b[0] >= 0xE0, 3, 2))
        point = np.select([size == 2, size == 3], [(b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63], (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)
        of = table[point]
        for k in range(4):
            kind[(lead + k)[size > k]] = of[size > k]
    head = np.zeros(n + 1, bool)
    head[off] = True
    run = np.ones(n + 1, bool)
    run[1:n] = (kind[1:] != kind[:-1]) | head[1:n]
    begin = run[:n].copy()
    # a run after white space: the last white character stands alone, or leads the run if it is a blank
    after = np.flatnonzero(run[1:n] & ~head[1:n] & (kind[:-1] == _WHITE)) + 1
    last = after - 1
    wide = text[last] >= 0x80
    while wide.any():
        wide &= text[last] & 0xC0 == 0x80
        last = last - wide
    begin[last] = True
    begin[after[text[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe at the start of a match, before these letters
    quote = np.flatnonzero((text[:-1] == 0x27) & begin[:-1] & run[1:n] & ~head[1:n] & (kind[1:] == _LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = text[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~run[third], text[third], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        begin[quote[short | long] + 1] = False
        stop = np.where(short, quote + 2, quote + 3)[short | long]
        stop = stop[stop < n]
        begin[stop[~run[stop]]] = True
    return np.flatnonzero(begin)


def _split(pattern_text: str, data: np.ndarray, off: np.ndarray, i: int, j: int):
    """(bytes, begins, ends, document, hash, second hash) of the pre-tokens of documents i to j."""
    text, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
    if pattern_text == KNOWN_PATTERN:
        begin = pretokens(text, o)
        end = np.r_[begin[1:], len(text)] if len(begin) else begin
    else:
        spans = [(m.start(), m.end(), k) for k in range(j - i) for m in pattern(pattern_text).finditer(text[o[k] : o[k + 1]].tobytes().decode())]
        char = [np.r_[np.flatnonzero(text[o[k] : o[k + 1]] & 0xC0 != 0x80), o[k + 1] - o[k]] + o[k] for k in range(j - i)]
        begin, end = (np.array([char[s[2]][s[e]] for s in spans], np.int64) for e in (0, 1))
    return text, begin, end, np.searchsorted(o, begin, side="right") - 1, *_hashes(text, begin, end)


def _hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of stretches of bytes, of 63 and 32 bits."""
    one, two = shared.stretch_hashes(text, begin, end)
    return (one >> np.uint64(1)).view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _distinct(pattern_text):
    def run(batches):
        counts: dict[bytes, int] = {}

        def made():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for b in batches:
            data, off = shared.buffers(b.column(0))
            for i, j in shared.chunks(off):
                text, begin, end, _, h, more = _split(pattern_text, data, off, i, j)
                _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if (more[first][of] != more).any():  # unequal pre-tokens with one hash
                    first, n = np.arange(len(h)), np.ones(len(h), np.int64)
                raw = text.tobytes()
                for s, t, c in zip(begin[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                    word = raw[s:t]
                    counts[word] = counts.get(word, 0) + c
                if len(counts) > FLUSH:
                    yield made()
                    counts = {}
        if counts:
            yield made()

    return run


def _encoded(path, pattern_text):
    def run(batches):
        encode = encoding(path, pattern_text).encode_ordinary
        for b in batches:
            ids = [np.array(encode(w), np.uint32).tobytes() for w in b.column(0).to_pylist()]
            data, off = shared.buffers(b.column(0))
            h, more = _hashes(data[off[0] : off[-1]], off[:-1] - off[0], off[1:] - off[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h), pa.array(more), pa.array(ids, pa.binary())], ["word", "n", "hash", "more", "ids"])

    return run


def vocabulary(docs: DataFrame, ranks_path: str, pattern_text: str, text_col: str = "text") -> DataFrame:
    """(hash, more, n, short, ids binary of little-endian uint32) of every distinct pre-token, written once.

    ``hash``, ``more``: two independent hashes; ``short``: whether it has HOT_BYTES bytes at most.
    """
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_distinct(pattern_text), "word string, n bigint")
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    encoded = words.mapInArrow(_encoded(ranks_path, pattern_text), "word string, n bigint, hash bigint, more int, ids binary")
    return shared.stage(encoded.select("hash", "more", "n", (F.octet_length("word") <= HOT_BYTES).alias("short"), "ids"), "bpe-words")


def _hot(words: DataFrame):
    """Condition for the most frequent short pre-tokens, ``HOT`` at most, from a histogram."""
    short = F.col("short") & (F.octet_length("ids") <= 4 * HOT_BYTES)
    step = F.floor(F.log2("n") * 8)
    total, least = 0, 1 << 30
    for s in words.where(short).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += s["rows"]
        if total > HOT:
            break
        least = s["step"]
    return short & (step >= least)


def _pack(ranks: np.ndarray, compress) -> bytes:
    """Ranks below 2^24 as three planes of bytes; frequent ones are small, so two are nearly empty."""
    planes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return compress(np.ascontiguousarray(planes[:, :3].T).tobytes())


def _unpack(packed: bytes, decompress) -> np.ndarray:
    planes = np.frombuffer(decompress(packed), np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def encode(docs: DataFrame, ranks_path: str, pattern_text: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, ids binary, decoded binary): token ids (little-endian uint32) of each whole text.

    ``decoded``: the ids' bytes again.  Null text counts as empty and has no ids.  Every row gives
    one row, repeated ones too: rows are told apart by a hash of id and text, and equal rows have
    equal ids.
    """
    sc = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)[id_col]
    words = vocabulary(docs, ranks_path, pattern_text, text_col)
    hot = _hot(words)
    # HOT rows at most, as arrays without a Python object each
    chosen = words.where(hot).select("hash", "more", "n", F.octet_length("ids").alias("size"), "ids").toArrow()
    hashes, more, count, size = (chosen.column(c).to_numpy().astype(np.int64) for c in ("hash", "more", "n", "size"))
    order = np.lexsort((more, hashes, -count))
    ids = np.frombuffer(shared.joined(chosen.column("ids").take(pa.array(order))), np.uint32)
    hot_size = np.r_[size[order] // 4, 0]
    table = sc.broadcast((shared.Lookup(hashes[order], np.arange(len(order))), np.r_[more[order], 0].astype(np.int32), hot_size, ids.tobytes()))
    del chosen, hashes, more, count, size, order, ids
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))

    def rank_of(h, more):
        """(rank, known); a pre-token that shares its hash with a hot one but isn't it is unknown."""
        ranks, seconds, *_ = table.value
        rank, known = ranks.get(h)
        rank = np.where(known, rank, len(seconds) - 1).astype(np.int64)
        return rank, known & (seconds[rank] == more)

    def rare(batches):
        """(key, hash, more, at): positions of pre-tokens that aren't hot."""
        for b in batches:
            data, off = shared.buffers(b.column(0))
            keys = b.column(1).to_numpy()
            for i, j in shared.chunks(off):
                _, _, _, doc, h, more = _split(pattern_text, data, off, i, j)
                at = np.flatnonzero(~rank_of(h, more)[1])
                if not len(at):
                    continue
                first = np.searchsorted(doc, np.arange(j - i))
                d, h, more = doc[at], h[at], more[at]
                order = np.lexsort((at, more, h, d))
                d, h, more, place = d[order], h[order], more[order], (at[order] - first[d[order]]).astype(np.uint32)
                edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (more[1:] != more[:-1])])
                cut = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((np.r_[edge, len(d)] * 4).astype(np.int32)), pa.py_buffer(place)])
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][d[edge]]), pa.array(h[edge]), pa.array(more[edge]), cut], ["key", "hash", "more", "at"])

    def ranked(batches):
        """(key, id, packed): the hot rank of every pre-token, one more than the last where it isn't hot."""
        cold = len(table.value[1]) - 1
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            data, off = shared.buffers(b.column(1))
            packed = []
            for i, j in shared.chunks(off):
                _, _, _, doc, h, more = _split(pattern_text, data, off, i, j)
                rank, known = rank_of(h, more)
                rank = np.where(known, rank, cold)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                packed += [_pack(rank[s:t], compress) for s, t in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(packed, pa.binary())], ["key", "id", "packed"])

    def made(ids, type_, texts, back):
        return pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(texts, pa.binary()), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    def reassembled(batches):
        """Texts' rows follow the joined rows of the same key."""
        decompress, tokens = zstandard.ZstdDecompressor().decompress, token_bytes(ranks_path)
        _, _, size, flat = table.value
        begin, flat, cold = np.cumsum(size) - size, np.frombuffer(flat, np.uint32), len(size) - 1
        now, joined = None, []
        for b in batches:
            ids, texts, back, held = [], [], [], 0
            for key, at, word_ids, id_, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    now, joined = key, []
                if packed is None:
                    joined.append((at, word_ids))
                    continue
                rank = _unpack(packed, decompress)
                n = size[rank]
                if joined:
                    at = np.frombuffer(b"".join(a for a, _ in joined), np.uint32)
                    times, length = (np.array([len(p[k]) // 4 for p in joined]) for k in (0, 1))
                    n[at] = np.repeat(length, times)
                first = np.cumsum(n) - n
                # where each id comes from: the hot table, or the joined ids after it
                source = begin[rank]
                pool = flat
                if joined:
                    pool = np.frombuffer(b"".join(w for _, w in joined), np.uint32)
                    source[at] = np.repeat(np.cumsum(length) - length, times)
                take = np.repeat(source - first, n) + np.arange(int(n.sum()))
                if joined:
                    is_cold = np.repeat(rank == cold, n)
                    res = np.empty(len(take), np.uint32)
                    res[is_cold], res[~is_cold] = pool[take[is_cold]], flat[take[~is_cold]]
                else:
                    res = flat[take]
                ids.append(id_)
                texts.append(res.tobytes())
                back.append(decode(res, tokens))
                held += len(texts[-1]) + len(back[-1])
                if held > 8 * shared.CHUNK_BYTES:
                    yield made(ids, b.column(3).type, texts, back)
                    ids, texts, back, held = [], [], [], 0
            if ids:
                yield made(ids, b.column(3).type, texts, back)

    joined = rows.select("text", "key").mapInArrow(rare, "key bigint, hash bigint, more int, at binary").join(words.select("hash", "more", "ids"), ["hash", "more"])
    joined = shared.stage(joined.select("key", "at", "ids"), "bpe-joined")
    joined = joined.select("key", "at", "ids", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("packed"))
    texts = rows.mapInArrow(ranked, f"key bigint, id {kind}, packed binary").select("key", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("ids"), "id", "packed")
    both = joined.unionByName(texts).repartition("key").sortWithinPartitions("key", F.col("packed").asc_nulls_first())
    return both.mapInArrow(reassembled, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` as n_tokens and SHA-256 in lowercase hex; other columns stay."""
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    return encoded.select(*rest, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary_file(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
