"""Spans that titles of a group share, and spans that one has alone, by sorted suffixes.

The suffixes of all titles are sorted by group and text, as pieces of PIECES times ``scans.PIECE``
rows, about, of a suffix array that no task holds.  The longest run at a place of a title that another
title has, too, is the longer of the prefixes it shares with its two nearest suffixes of other titles.
Spark sorts a piece, whose neighbours are then compared once each, as arrays; what a piece doesn't
know of others, four entries a piece and group carry over.  So no pair of titles is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..staging import staged
from . import scans

#: Characters of a title that count (a power of two less one at most bounds the shared prefix).
MOST = 200
#: Suffixes that are compared at once, and ``scans.PIECE`` of them in a piece of the array.
ROWS, PIECES = 4096, 4
# What parts a title's segments, and what their edges lose.
SEPARATORS = r"_\-|｜·•,，、;；:：()（）\[\]【】<>《》\"'“”…\s"
EDGE = r"^\.+|\.+$"


def shared_prefix(a: str, b: str) -> Column:
    """Length of the prefix two text columns share, by halving steps; 0 where one is null."""
    steps = ", ".join(str(1 << k) for k in range(MOST.bit_length() - 1, -1, -1))
    fits = f"n + s <= least(length({a}), length({b})) AND substr({a}, 1, n + s) = substr({b}, 1, n + s)"
    return F.expr(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE aggregate(array({steps}), 0, (n, s) -> CASE WHEN {fits} THEN n + s ELSE n END) END")


#: Rows of ``_piece``: a suffix, or (LAST to EARLY) an entry of a group in a piece: its last one and
#: the last one of another title, its first one and the first one of another title.
SUFFIX, LAST, LATE, FIRST, EARLY = range(5)
ROW = "kind int, group string, id bigint, at int, low int, high int, suffix string"


def _common(suffix: pa.Array) -> np.ndarray:
    """Length of the prefix that each string shares with the one before; 0 for the first."""
    size = pc.utf8_length(suffix).to_numpy()
    out = np.zeros(len(size), np.int64)
    for k in range(0, len(size) - 1, ROWS):
        part = suffix[k : k + ROWS + 1].to_pylist()
        width = max(1, max(map(len, part)))
        chars = np.array(part, f"U{width}").view(np.uint32).reshape(len(part), width)
        same = np.c_[chars[1:] == chars[:-1], np.zeros(len(part) - 1, bool)].argmin(1)
        # ends are padded: a shared prefix is no longer than either
        out[k + 1 : k + len(part)] = np.minimum(same, np.minimum(size[k : k + len(part) - 1], size[k + 1 : k + len(part)]))
    return out


def _piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWs of a piece's suffixes (group, id, at, suffix), which come in order.

    ``low``, ``high``: the prefix shared with the nearest suffix of another title before and after;
    null, with the suffix, where the piece has none of its group.  Between the two lie suffixes of
    the same title, so it is the least of the prefixes that neighbours share from one to the other.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    group, suffix = rows.column("group").combine_chunks(), rows.column("suffix").combine_chunks()
    ids, n = rows.column("id").to_numpy(), len(rows)
    told = group.dictionary_encode().indices.to_numpy()
    begins = np.r_[True, told[1:] != told[:-1]]
    run = np.r_[True, ids[1:] != ids[:-1]] | begins
    common = _common(suffix)
    low, high = common.copy(), np.r_[common[1:], 0]
    for i in np.flatnonzero(~run):
        low[i] = min(low[i], low[i - 1])
    for i in np.flatnonzero(~run)[::-1] - 1:
        high[i] = min(high[i], high[i + 1])
    # runs of one title, and those that begin and end a group's part of the piece
    head = np.flatnonzero(run)
    tail = np.r_[head[1:], n] - 1
    of = np.cumsum(run) - 1
    opens = begins[head]
    closes = np.r_[opens[1:], True]
    none_low, none_high = opens[of], closes[of]
    column = lambda x, none: pa.array(x.astype(np.int32), mask=none)
    ends = [(SUFFIX, np.arange(n))]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    several = first != last
    ends += [(LAST, tail[last]), (LATE, tail[last[several] - 1]), (FIRST, head[first]), (EARLY, head[first[several] + 1])]
    lows, highs = column(low, none_low), column(high, none_high)
    kept = pc.if_else(pa.array(none_low | none_high), suffix, pa.scalar(None, suffix.type))
    for kind, take in ends:
        which = pa.array(take)
        texts = kept if kind == SUFFIX else suffix
        columns = [pa.array(np.full(len(take), kind, np.int32)), group.take(which), *(rows.column(c).combine_chunks().take(which) for c in ("id", "at")), lows.take(which), highs.take(which), texts.take(which)]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "group", "id", "at", "low", "high", "suffix"])


def _carried(rows: DataFrame, nearest: int, other: int, descending: bool) -> DataFrame:
    """(group, piece, __e, __o): the nearest entry of the pieces before (after), and the nearest of another title."""
    way = F.desc if descending else F.asc
    two = rows.where(F.col("kind").isin(nearest, other)).select("group", "piece", (F.col("kind") == nearest).cast("int").alias("nth"), F.struct("id", "suffix").alias("e"))
    over = Window.partitionBy("group").orderBy(way("piece"), "nth")
    run = two.withColumn("__before", F.when(F.col("e.id") != F.lag("e.id").over(over), F.lag("e").over(over)))
    run = run.withColumn("o", F.last("__before", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))).where("nth = 1")
    by_piece = Window.partitionBy("group").orderBy(way("piece"))
    return run.select("group", "piece", F.lag("e").over(by_piece).alias("__e"), F.lag("o").over(by_piece).alias("__o"))


def shared(titles: DataFrame) -> DataFrame:
    """(group, title, n, runs, met): for each distinct title of (group, title) the run at each of its places that others have.

    ``runs``: lengths by place, of at most MOST characters; a title that several rows have is held
    whole by another.  ``met``: whether its group has another row with a title.  Null and empty titles have no place; a null group is a group.
    """
    cut = titles.select("group", F.substring("title", 1, MOST).alias("title")).where("title <> ''")
    items = cut.groupBy("group", "title").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("group", "title"))
    items = staged(items.withColumn("group", F.coalesce(F.col("group").cast("string"), F.lit("\x00"))), "span-titles")
    suffixes = items.select("group", "id", F.posexplode(F.expr("transform(sequence(1, length(title)), i -> substr(title, i))")).alias("at", "suffix"))
    n = max(1, -(-(items.agg(F.sum(F.length("title"))).first()[0] or 0) // (PIECES * scans.PIECE)))
    order = ["group", "suffix", "id", "at"]
    dealt = (suffixes.repartitionByRange(n, *order) if n > 1 else suffixes.coalesce(1)).sortWithinPartitions(*order)
    rows = staged(dealt.mapInArrow(_piece, ROW).withColumn("piece", F.spark_partition_id()), "span-pieces")
    whole = rows.where(F.col("kind") == SUFFIX)
    open_ = whole.where("low IS NULL OR high IS NULL")
    for name, far in (("low", _carried(rows, LAST, LATE, False)), ("high", _carried(rows, FIRST, EARLY, True))):
        open_ = open_.join(far, ["group", "piece"], "left").withColumn("__far", F.when(F.col("__e.id") != F.col("id"), F.col("__e.suffix")).otherwise(F.col("__o.suffix")))
        open_ = open_.withColumn(name, F.coalesce(name, F.when(F.col("__far").isNotNull(), shared_prefix("suffix", "__far")))).drop("__e", "__o", "__far")
    every = whole.where("low IS NOT NULL AND high IS NOT NULL").unionByName(open_)
    run = F.coalesce(F.greatest("low", "high"), F.lit(0))
    each = F.sort_array(F.collect_list(F.col("at") * (MOST + 1) + run))
    runs = every.groupBy("group", "id").agg(F.transform(each, lambda r: r % (MOST + 1)).alias("runs"), F.max(F.col("low").isNotNull() | F.col("high").isNotNull()).alias("met"))
    whole = F.expr("CASE WHEN n > 1 THEN transform(sequence(1, length(title)), i -> length(title) - i + 1) ELSE runs END")
    found = items.join(runs, ["group", "id"]).withColumn("runs", whole)
    return found.select(F.nullif("group", F.lit("\x00")).alias("group"), "title", "n", "runs", (F.col("met") | (F.col("n") > 1)).alias("met"))


def spans(titles: DataFrame, label: str = "''", most: int = 14) -> DataFrame:
    """(group, title, n, shared, own) of distinct titles.

    ``shared``: the longest span that another title has, the first of these ('' without one).
    ``own``: where a title is not held whole by another, its longest segment of two characters or more
    that no other title holds and that lacks ``label`` (an expression); else its longest segment;
    of equals the first, ``most`` characters of it.  '' for a title without letters, digits or CJK
    and for one that is alone in its group.
    """
    found = shared(titles)
    longest = F.array_max("runs")
    first = F.expr("coalesce(substr(title, CAST(array_position(runs, array_max(runs)) AS INT), array_max(runs)), '')")
    # segments with the place of their first character, edges stripped
    parting, rest, edge, head = (SPARK.lit(x) for x in (f"[{SEPARATORS}]", f"^[^{SEPARATORS}]+", EDGE, r"^\.*"))
    begins = f"filter(sequence(1, length(title)), i -> NOT regexp_like(substr(title, i, 1), {parting}) AND (i = 1 OR regexp_like(substr(title, i - 1, 1), {parting})))"
    raw = f"transform({begins}, i -> named_struct('at', i, 'text', regexp_extract(substr(title, i), {rest}, 0)))"
    parts = f"filter(transform({raw}, p -> named_struct('at', p.at + length(regexp_extract(p.text, {head}, 0)), 'text', regexp_replace(p.text, {edge}, ''))), p -> p.text <> '')"
    parted = found.withColumn("segments", F.expr(parts)).withColumn("label", F.expr(label))
    free = "filter(segments, p -> length(p.text) >= 2 AND runs[p.at - 1] < length(p.text) AND (label = '' OR NOT contains(p.text, label)))"
    of = lambda xs: f"get(filter({xs}, p -> length(p.text) = array_max(transform({xs}, w -> length(w.text)))), 0).text"
    own = F.expr(f"CASE WHEN NOT met OR length(title) < 2 OR runs[0] >= length(title) OR NOT title RLIKE '[A-Za-z0-9\\u4e00-\\u9fff]' THEN '' ELSE substr(coalesce({of(free)}, {of('segments')}, title), 1, {most}) END")
    return parted.select("group", "title", "n", F.when(longest > 0, first).otherwise("").alias("shared"), own.alias("own"))
