"""Suffix-array dedup: repeated byte strings of ``LENGTH``, found by two-stage suffix sorting.

Suffixes are dealt so that equal ``LENGTH``-byte strings meet.  Every such string is owned by the
least hash of its ``GRAM``-byte grams (winnowing: equal strings choose the same gram at the same
place), so the starts of a text fall into short runs, each owned by one anchor.  Runs are grouped
by anchor: an anchor met once owns no repeat, and runs with equal bytes all repeat.  Where an
anchor has differing runs, one of each kind goes to a task that builds a suffix array over them:
only suffixes smaller than their successors are sorted directly (and the last of a run, whose
successor isn't there), the others are induced by one scan over the buckets of first bytes.
Adjacent common prefixes of ``LENGTH`` or more mark the repeats.

Anchors with more than ``GROUP`` differing runs are cut into blocks.  Each block's suffix array
passes on one string of every repeat it found and all strings it found once.  They go in pieces of
``PIECE`` neighbouring starts at fixed places from the anchor, by the hash of what all strings of
a piece share; pieces met once hold no repeat, and the strings of the others meet by 128 bits of a
cryptographic hash.  No other hash decides what is equal: anchors and pieces only say where to look.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM, GROUP, PIECE = 400, 64, 1000, 8
#: What tells runs apart: their anchor and 128 bits of their bytes.
KIND = ["anchor", "content", "check"]
#: Bits of a place in a step (a document has fewer bytes); anchors go by the other bits of their hash, then by place.
PLACE = 32
#: Kinds of runs that are joined by broadcast, the most frequent ones.
HOT_KINDS = 50_000
#: Bytes of runs that one suffix array holds, about.
ARRAY_BYTES = 1 << 21
_U = np.uint64


def _sums(text: np.ndarray) -> np.ndarray:
    p, _ = shared.powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((text.astype(_U) + _U(1)) * p[: len(text)], out=sums[1:], dtype=_U)
    return sums


def _hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = shared.powers(len(sums))
    with np.errstate(over="ignore"):
        return shared.mix((sums[end] - sums[begin]) * inverse[begin])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    blocks = np.full(size, ~_U(0), _U)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, off: np.ndarray):
    """(doc, begin, last, place, anchor, content, check): runs of starts of LENGTH-byte strings.

    ``place``: of the anchor from ``begin``; ``content`` and ``check``: 128 bits of a cryptographic
    hash of the run's bytes and ``place``, as equal ones are taken for equal bytes.
    Places are relative to each document; documents shorter than LENGTH have none.
    """
    text = data[off[0] : off[-1]]
    o = off - off[0]
    if len(text) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),) + (np.zeros(0, np.int64),) * 2
    sums = _sums(text)
    spots = np.arange(len(text) - GRAM + 1)
    gram = _hashes(sums, spots, spots + GRAM)
    # equal strings choose the same place wherever they lie: the same bits decide, then the first place
    owner = (_least(gram >> _U(PLACE) << _U(PLACE) | spots.astype(_U), LENGTH - GRAM + 1) & _U((1 << PLACE) - 1)).astype(np.int64)
    starts = np.arange(len(owner))
    doc = np.searchsorted(o, starts, side="right") - 1
    whole = starts + LENGTH <= o[doc + 1]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh & whole)
    ends = np.r_[np.flatnonzero(fresh)[1:], len(owner)]
    last = np.minimum(ends[np.searchsorted(np.flatnonzero(fresh), first)] - 1, o[doc[first] + 1] - LENGTH)
    place = owner[first] - first
    told = _digests(text, first, last + LENGTH, place)
    d = doc[first]
    return d, first - o[d], last - o[d], place, gram[owner[first]], told[:, 0], told[:, 1]


def _digests(text: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """(n, 2) numbers: BLAKE2b of each stretch of bytes."""
    view = memoryview(np.ascontiguousarray(text))
    parts = [hashlib.blake2b(view[b:e], digest_size=16, salt=s.to_bytes(8, "little")).digest() for b, e, s in zip(begin.tolist(), end.tolist(), salt.tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


# --- the suffix array ------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zeros beyond the end."""
    n = len(text)
    padded = np.zeros(n + LENGTH + 16, _U)
    padded[:n] = text
    word = np.zeros(n + LENGTH + 8, _U)
    for k in range(8):
        word |= padded[k : n + LENGTH + 8 + k] << _U(56 - 8 * k)
    return word


def suffix_array(text: np.ndarray, wanted: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """Places of the wanted suffixes of ``text``, in order of their first LENGTH bytes or more.

    ``wanted``: boolean by place.  Two stages: suffixes smaller than their successors are sorted
    directly; the others are induced, bucket by bucket, from successors that precede them.
    """
    n = len(text)
    word = _words(text) if word is None else word
    # smaller than the successor: decided where two neighbours differ next; the end counts as larger
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    turn = np.minimum.accumulate(np.where(differs, np.arange(n), n - 1)[::-1])[::-1]
    smaller = rises[turn]
    need = wanted.copy()
    fresh = np.flatnonzero(need & ~smaller)
    while len(fresh):  # what is induced needs its successor
        fresh = fresh + 1
        fresh = fresh[~need[fresh]]
        need[fresh] = True
        fresh = fresh[~smaller[fresh]]
    direct = _sorted(word, np.flatnonzero(need & smaller))
    induced = need & ~smaller
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    parts = []
    for c in range(256):
        wave, bucket = (np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)), []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
        bucket = np.concatenate([*bucket, direct[cut[c] : cut[c + 1]]])
        parts.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            byte = text[before]
            edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for b, part in zip(byte[edge], np.split(before, edge[1:]), strict=True):
                waiting[b].append(part)
    order = np.concatenate(parts)
    return order[wanted[order]]


def _sorted(word: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in order of the LENGTH bytes that begin there, eight at a time while they tie."""
    order = places[np.argsort(word[places], kind="stable")]
    w = word[order]
    tie = np.zeros(len(order) + 1, bool)  # with the one before
    tie[1:-1] = w[1:] == w[:-1]
    for at in range(8, LENGTH, 8):
        here = np.flatnonzero(tie[:-1] | tie[1:])
        if not len(here):
            break
        group = np.cumsum(~tie[here])
        w = word[order[here] + at]
        by = np.lexsort((w, group))
        order[here] = order[here][by]
        w, group = w[by], group[by]
        same = np.zeros(len(here), bool)
        same[1:] = (w[1:] == w[:-1]) & (group[1:] == group[:-1])
        tie[here] = same
    return order


def prefixes_shared(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``order`` shares LENGTH bytes with the one before."""
    alive = np.arange(1, len(order))
    for at in range(0, LENGTH, 8):
        alive = alive[word[order[alive] + at] == word[order[alive - 1] + at]]
    res = np.zeros(len(order), bool)
    res[alive] = True
    return res


_FOUND = ["kind", "hash", "key", "begin", "stop", "starts", "strings"]
SPAN, ONCE, TWICE = 0, 1, 2


def _searched(rows: list[tuple]):
    """Record batches of spans, and of strings to meet other blocks', from runs of whole blocks."""
    blocks, keys, begins, lasts, places, texts = zip(*rows, strict=True)
    text = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    starts = np.array(lasts) - np.array(begins) + 1
    run = np.repeat(np.arange(len(rows)), starts)
    spot = np.repeat(base, starts) + np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts)
    wanted = np.zeros(len(text), bool)
    wanted[spot] = True
    word = _words(text)
    order = suffix_array(text, wanted, word)
    same = prefixes_shared(word, order)
    repeated = np.zeros(len(text), bool)
    repeated[order[same]] = True
    repeated[order[:-1][same[1:]]] = True
    key, first = np.array(keys, np.int64), np.array(begins, np.int64) - base
    hit = repeated[spot]
    edge = np.r_[True, run[1:] != run[:-1]]
    head = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
    tail = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False]))
    ints = lambda x: pa.array(np.asarray(x, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), SPAN, np.int32)), ints(np.zeros(len(head))), ints(key[run[head]]), ints(spot[head] + first[run[head]]), ints(spot[tail] + first[run[tail]] + LENGTH), pa.nulls(len(head), pa.list_(pa.int64())), pa.nulls(len(head), pa.list_(pa.binary()))], _FOUND)
    cut = np.zeros(len(text), bool)
    cut[spot] = (np.array(blocks) > 1)[run]
    if cut.any():
        owner = np.zeros(len(text), np.int64)
        owner[spot] = run
        sums, anchor = _sums(text), base + np.array(places)
        for kind, at in ((ONCE, order[~repeated[order] & cut[order]]), (TWICE, order[repeated[order] & ~same & cut[order]])):
            at = np.sort(at)
            if not len(at):
                continue
            of = owner[at]
            piece = (anchor[of] - at) // PIECE
            edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (piece[1:] != piece[:-1])])
            begin = anchor[of[edge]] - PIECE * piece[edge]
            shared_part = shared.mix(_hashes(sums, begin, begin + LENGTH - PIECE + 1) + piece[edge].astype(_U))
            lists = lambda x, kind=pa.int64(), edge=edge: pa.ListArray.from_arrays(pa.array(np.r_[edge, len(x)], pa.int32()), pa.array(x, kind))
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), kind, np.int32)), pa.array(shared_part.view(np.int64)), ints(key[of[edge]]), none, none, lists(at + first[of]), lists([x.tobytes() for x in _digests(text, at, at + LENGTH, np.zeros(len(at), np.int64))], pa.binary())], _FOUND)


def _search(batches):
    """Suffix arrays over the runs dealt here, in order of anchor and block."""
    held, size, now = [], 0, None
    for b in batches:
        for anchor, block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > ARRAY_BYTES and (anchor, block) != now:
                yield from _searched(held)
                held, size = [], 0
            now = anchor, block
            held.append(tuple(row))
            size += len(row[-1])
    if held:
        yield from _searched(held)


def _cut(batches):
    """Runs of the documents (key, content): (anchor, content, check, key, begin, last, place)."""
    for b in batches:
        data, off = shared.buffers(b.column(1))
        key = b.column(0).to_numpy()
        for i, j in shared.chunks(off):
            d, begin, last, place, anchor, content, check = runs(data, off[i : j + 1])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), content, check, key[i:j][d], begin, last, place)], ["anchor", "content", "check", "key", "begin", "last", "place"])


def _fetched(batches):
    """Bytes of the runs that are asked for."""
    for b in batches:
        data, off = shared.buffers(b.column(1))
        out, held = [], 0
        for k, (key, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            for w in wanted:
                out.append((w["anchor"], w["block"], w["blocks"], key, w["begin"], w["last"], w["place"], data[off[k] + w["begin"] : off[k] + w["last"] + LENGTH].tobytes()))
                held += len(out[-1][-1])
            if held > 8 * shared.CHUNK_BYTES:
                yield _run_batch(out)
                out, held = [], 0
        if out:
            yield _run_batch(out)


def _run_batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "block", "blocks", "key", "begin", "last", "place", "bytes"])


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))


def spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", group: int | None = None) -> DataFrame:
    """(key, begin, stop): byte spans covered by strings of LENGTH that start elsewhere too.

    ``key``: hash of id and text.  Spans of a document may overlap or repeat.  Rows that repeat id
    and text are different places: each is wholly repeated if it has LENGTH bytes.
    """
    group = GROUP if group is None else group
    keyed = _keyed(docs, text_col, id_col)
    every = shared.stage(keyed.select("key", "text").mapInArrow(_cut, "anchor bigint, content bigint, check bigint, key bigint, begin bigint, last bigint, place bigint"), "suffix-runs")
    kinds = every.groupBy(*KIND).agg(F.count("*").alias("n"))
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1").select("anchor", "kinds")
    known = shared.stage(kinds.join(anchors, "anchor"), "suffix-kinds")
    rows = _joined(every, known)
    equal = rows.where("n > 1").select("key", "begin", (F.col("last") + LENGTH).alias("stop"))
    differing = rows.where("kinds > 1").dropDuplicates(KIND)
    blocks = F.ceil(F.col("kinds") / group).cast("int")
    asked = differing.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("key", "begin"), F.col("blocks")))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "block", "blocks", "begin", "last", "place")).alias("wanted"))
    fetched = keyed.select("key", "text").join(asked, "key").mapInArrow(_fetched, "anchor bigint, block int, blocks int, key bigint, begin bigint, last bigint, place bigint, bytes binary")
    dealt = fetched.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    found = shared.stage(dealt.mapInArrow(_search, "kind int, hash bigint, key bigint, begin bigint, stop bigint, starts array<bigint>, strings array<binary>"), "suffix-found")
    pieces = found.where(F.col("kind") != SPAN).select("kind", "hash", "key", "starts", "strings")
    met = pieces.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    live = pieces.join(met, "hash").select("kind", "key", F.explode(F.arrays_zip("starts", "strings")).alias("s")).select("kind", "key", F.col("s.starts").alias("begin"), F.col("s.strings").alias("string"))
    twice = live.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    late = live.where(F.col("kind") == ONCE).join(twice, "string").select("key", "begin", (F.col("begin") + LENGTH).alias("stop"))
    return equal.unionByName(found.where(F.col("kind") == SPAN).select("key", "begin", "stop")).unionByName(late)


def _joined(every: DataFrame, known: DataFrame) -> DataFrame:
    """``every`` joined to ``known``, whose most frequent kinds are broadcast, so that no task gets all runs of one."""
    step = F.floor(F.log2("n") * 4)
    total, least = 0, 1 << 30
    for s in known.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += s["rows"]
        if total > HOT_KINDS:
            break
        least = s["step"]
    hot = (F.col("n") > 1) & (step >= least)
    often = F.broadcast(known.where(hot))
    rest = every.join(often.select(KIND), KIND, "left_anti")
    return every.join(often, KIND).unionByName(rest.join(known.where(~hot), KIND))


def _removed(batches):
    for b in batches:
        data, off = shared.buffers(b.column(1))
        sizes, gone, count, kept, held, ids = [], [], [], [], 0, []
        for k, (id_, where) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            text = data[off[k] : off[k + 1]]
            steps = np.zeros(len(text) + 1, np.int32)
            for w in where or ():
                steps[w["begin"]] += 1
                steps[w["stop"]] -= 1
            covered = np.cumsum(steps[:-1]) > 0
            ids.append(id_)
            sizes.append(len(text))
            gone.append(int(covered.sum()))
            count.append(int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(text) else 0)
            kept.append(text[~covered].tobytes())
            held += len(kept[-1])
            if held > 8 * shared.CHUNK_BYTES:
                yield _kept_batch(b, ids, sizes, gone, count, kept)
                sizes, gone, count, kept, held, ids = [], [], [], [], 0, []
        if ids:
            yield _kept_batch(b, ids, sizes, gone, count, kept)


def _kept_batch(b, ids, sizes, gone, count, kept):
    return pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept binary) of every row.

    Each byte covered by a LENGTH-byte string that also starts anywhere else, in any text, goes;
    strings are judged on the input.  ``n_spans``: maximal removed runs; ``kept``: the remaining
    bytes, which may cut a character.  Null and empty texts have no bytes; an empty table no rows.
    """
    where = spans(docs, text_col, id_col).distinct().groupBy("key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    joined = _keyed(docs, text_col, id_col).join(where, "key", "left").select("id", "text", "spans")
    return joined.mapInArrow(_removed, f"id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)
