"""Hard negatives by a Voronoi-partitioned exact nearest-neighbour join of anchors and all rows.

Inner products become distances by one more component: a row x gets sqrt(M^2 - |x|^2), M being the
largest norm, an anchor gets 0, so that a larger product is a smaller distance.  Pivots are fitted on
a bounded sample; every row belongs to the cell of its nearest pivot and knows its distance d to it.
Cells' histograms of d bound how far an anchor's neighbours can be, and with the anchor's own
distances to the pivots the triangle inequality says which d of which cell can hold one.  Anchors
are grouped by cells; a row is replicated to just the groups whose bounds it meets, in blocks of
bounded size, and joined there exactly by integer inner products.  Partial results of the blocks
are merged by anchor.

Two such joins follow each other: positives (the nearest of an anchor's own label), and negatives
(of other labels, the nearest within a window of scores below each positive).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that pivots are fitted on (those of least hash), pivots at most, and rounds of fitting.
SAMPLE, PIVOTS, ROUNDS = 2048, 128, 5
#: Anchors of a group of cells, about, and groups at most; anchors and rows of one local join, about.
GROUP_ANCHORS, MAX_GROUPS, ANCHORS, ROWS = 1024, 128, 2048, 8192
#: Steps of a cell's histogram of distances, and histogram rows by cell and label that bounds use.
STEPS, BOUND_ROWS = 16, 50_000
#: Anchors whose products one step holds.
STEP_ANCHORS = 128
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers, zeros beyond a shorter list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, int)
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), kind)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties by smaller id; the least value is none."""
    none, n = scores.dtype.type(np.finfo(scores.dtype).min if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min), scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), none)
    row, at = np.nonzero((scores >= least[:, None]) & (scores > none))
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], at[keep]


def fitted(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots of a sample: Lloyd's rounds from rows that are far apart."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(pivots, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    out = vectors[chosen]
    for _ in range(ROUNDS):
        home = distances(vectors, out).argmin(1)
        for c in range(len(out)):
            if (home == c).any():
                out[c] = vectors[home == c].mean(0)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Space:
    """What tasks know: dimensions, the largest squared norm, the pivots, and what rounding may add."""

    def __init__(self, width: int, square: float, pivots: np.ndarray):
        self.width, self.square, self.pivots = width, square, pivots
        self.slack = 1e-5 * np.sqrt(square) + 1e-9
        # products and their partial sums stay within the largest squared norm, so these are exact
        self.kind = np.float32 if square < 1 << 24 else np.float64 if square < 1 << 53 else np.int64

    def lifted(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        more = np.zeros(len(vectors)) if anchors else np.sqrt(np.maximum(self.square - (vectors * vectors).sum(1), 0))
        return np.c_[vectors, more]


def prepared(vectors: DataFrame, label_col: str = "label", vector_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, label, v array<bigint>) of rows with id, label and a vector of finite components.

    Components are floor(scale * x), x as double.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def assigned(rows: DataFrame, anchors: int) -> tuple[DataFrame, Space] | None:
    """(id, label, v, cell, d) staged, and the space; None without rows.

    A repeated row counts once; vectors of several lengths are filled up with zeros.
    """
    spark = rows.sparkSession
    squared = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    seen = rows.agg(F.max(F.size("v")).alias("width"), F.max(squared).alias("square"), F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda t, x: F.greatest(t, F.abs(x)))).alias("most")).first()
    if seen["width"] is None:
        return None
    if seen["square"] >= 1 << 63:
        raise ValueError("inner products beyond 64 bits")
    width = max(1, seen["width"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    space = Space(width, seen["square"], np.zeros((1, width + 1)))
    space.pivots = fitted(space.lifted(matrix(sample.column(0), width), False), max(1, min(PIVOTS, anchors // 8)))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            far = distances(space.lifted(matrix(b.column(2), width), False), space.pivots)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], ["id", "label", "v", "cell", "d"])

    small = rows.withColumn("v", F.col("v").cast("array<smallint>")) if seen["most"] < 1 << 15 else rows
    kinds = dict(small.dtypes)
    return shared.stage(small.mapInArrow(run, f"id bigint, label {kinds['label']}, v {kinds['v']}, cell int, d double"), "neighbour-rows"), space


# --- bounds ----------------------------------------------------------------------------------


class Histogram:
    """Numbers of rows by cell and step of distance, and by label besides; bounded, on the driver."""

    def __init__(self, rows: DataFrame, space: Space):
        step = F.least(F.lit(STEPS - 1), F.floor(F.col("d") / float(2 * np.sqrt(space.square) + 1e-9) * STEPS)).cast("int")
        by = shared.stage(rows.groupBy("cell", "label", step.alias("step")).agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")), "neighbour-steps")
        whole = by.groupBy("cell", "step").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()
        self.cell, self.n, self.near, self.far = (np.array([r[c] for r in whole]) for c in ("cell", "n", "near", "far"))
        # fewer entries make looser bounds, not wrong ones
        self.of: dict = {}
        for r in by.orderBy(F.desc("n"), "cell", "label", "step").limit(BOUND_ROWS).collect():
            self.of.setdefault(r["label"], []).append((r["cell"], r["n"], r["far"]))
        self.of = {k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in self.of.items()}

    def within(self, label, to_pivots: np.ndarray, k: int) -> float:
        """A distance within which k rows of the label are, at least, for an anchor at these distances."""
        if label not in self.of:
            return np.inf
        cell, n, far = self.of[label]
        reach = to_pivots[cell] + far
        order = np.argsort(reach)
        at = int(np.searchsorted(np.cumsum(n[order]), k))
        return float(reach[order[at]]) if at < len(order) else np.inf


def _spread(space: Space, low_high):
    """Rows (cell, pivot, low, high): what d of a pivot's rows the anchors of a cell may need."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            to = distances(space.lifted(matrix(b.column("v"), space.width), True), space.pivots)
            low, high = low_high(b, to)
            low, high = low - space.slack, high + space.slack
            cell = to.argmin(1)
            for c in np.unique(cell):
                mine = cell == c
                p = len(space.pivots)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(p, c), pa.int32()), pa.array(np.arange(p), pa.int32()), pa.array(low[mine].min(0)), pa.array(high[mine].max(0)), pa.array(np.full(p, mine.sum()), pa.int64())], ["cell", "pivot", "low", "high", "n"])

    return run


class Groups:
    """Cells of anchors in groups of about GROUP_ANCHORS, the bounds of each, and its blocks."""

    def __init__(self, anchors: DataFrame, space: Space, histogram: Histogram, low_high):
        found = anchors.mapInArrow(_spread(space, low_high), "cell int, pivot int, low double, high double, n bigint")
        found = found.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
        p = len(space.pivots)
        counts = np.zeros(p, np.int64)
        for r in found:
            counts[r["cell"]] = r["n"]
        self.home = np.zeros(p, np.int64)
        size = max(GROUP_ANCHORS, -(-int(counts.sum()) // MAX_GROUPS))
        left, at, apart = [int(c) for c in np.flatnonzero(counts)], 0, distances(space.pivots, space.pivots)
        while left:
            # the cell farthest from all others begins a group, its nearest ones follow
            seed = max(left, key=lambda c: float(apart[c, left].sum()))
            held = 0
            for c in sorted(left, key=lambda c: float(apart[seed, c])):
                if held and held + counts[c] > size:
                    break
                self.home[c], held = at, held + int(counts[c])
                left.remove(c)
            at += 1
        self.low, self.high, self.anchors = np.full((max(1, at), p), np.inf), np.full((max(1, at), p), -np.inf), np.zeros(max(1, at), np.int64)
        for r in found:
            g = self.home[r["cell"]]
            self.low[g, r["pivot"]], self.high[g, r["pivot"]] = min(self.low[g, r["pivot"]], r["low"]), max(self.high[g, r["pivot"]], r["high"])
        for c in np.flatnonzero(counts):
            self.anchors[self.home[c]] += counts[c]
        meets = (self.low[:, histogram.cell] <= histogram.far) & (self.high[:, histogram.cell] >= histogram.near)
        self.rows = (meets * histogram.n).sum(1)
        self.anchor_blocks, self.row_blocks = (np.maximum(1, -(-x // most)).astype(int).tolist() for x, most in ((self.anchors, ANCHORS), (self.rows, ROWS)))

    def dealt(self, anchors: DataFrame, rows: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
        """Both sides with (group, part, block): where they meet, an anchor and a row in one place only."""
        home, low, high, pivots, width = self.home, self.low, self.high, space.pivots, space.width

        def of_rows(batches):
            for b in batches:
                cell, d = b.column("cell").to_numpy(), b.column("d").to_numpy()
                row, group = np.nonzero(((low[:, cell] <= d) & (high[:, cell] >= d)).T)
                sent = b.select(["id", "label", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(group, pa.int32())], ["id", "label", "v", "group"])

        def of_anchors(batches):
            for b in batches:
                to = distances(space.lifted(matrix(b.column("v"), width), True), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home[to.argmin(1)], pa.int32())], [*b.schema.names, "group"])

        parts, blocks = (F.element_at(F.array(*(F.lit(int(n)) for n in of)), F.col("group") + 1) for of in (self.anchor_blocks, self.row_blocks))
        ddl = lambda df, *names: ", ".join(f"`{n}` {dict(df.dtypes)[n]}" for n in names)
        r = rows.mapInArrow(of_rows, ddl(rows, "id", "label", "v") + ", `group` int")
        r = r.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        a = anchors.mapInArrow(of_anchors, ddl(anchors, *anchors.columns) + ", `group` int")
        a = a.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return a, r


def _once(table: pa.Table, width: int, kind, *more: str):
    """Ids in ascending order, labels, vectors and further columns of rows that differ in id, label or vector."""
    v = matrix(table.column("v"), width, kind)
    ids, label = table.column("id").to_numpy(), table.column("label").to_pylist()
    order = np.argsort(ids, kind="stable")
    seen, keep = set(), []
    repeated = len(np.unique(ids)) < len(ids)
    for i in order.tolist():
        key = (int(ids[i]), label[i], v[i].tobytes()) if repeated else None
        if key is None or key not in seen:
            seen.add(key)
            keep.append(i)
    return ids[keep], np.array([label[i] for i in keep], object), v[keep], table.take(pa.array(keep)).select(more)


def _codes(a: np.ndarray, b: np.ndarray):
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in xs.tolist()], np.int64) for xs in (a, b))


_PARTIAL = pa.schema([("anchor", pa.int64()), ("akey", pa.int64()), ("nth", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _joined(space: Space, search):
    """The local join: ``search`` gives (nth, row, column) lists from products and equality of labels."""
    lowest = np.finfo(space.kind).min if space.kind != np.int64 else np.iinfo(np.int64).min

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if anchors.num_rows and rows.num_rows:
            extra = [c for c in anchors.schema.names if c not in ("id", "label", "v", "group", "part", "block")]
            aid, alabel, av, more = _once(anchors, space.width, space.kind, *extra)
            rid, rlabel, rv, _ = _once(rows, space.width, space.kind)
            acode, rcode = _codes(alabel, rlabel)
            akey = more.column("akey").to_numpy()
            for i in range(0, len(aid), STEP_ANCHORS):
                j = slice(i, i + STEP_ANCHORS)
                scores = av[j] @ rv.T
                for nth, row, at in search(scores, acode[j, None] == rcode, aid[j], rid, more.slice(i, STEP_ANCHORS), lowest):
                    parts.append(pa.Table.from_arrays([pa.array(aid[j][row]), pa.array(akey[j][row]), pa.array(np.full(len(row), nth), pa.int32()), pa.array(rid[at]), pa.array(scores[row, at].astype(np.int64))], schema=_PARTIAL))
        return pa.concat_tables(parts) if parts else _PARTIAL.empty_table()

    return run


def _met(anchors: DataFrame, rows: DataFrame, groups: Groups, space: Space, search, k: int) -> DataFrame:
    """(anchor, akey, nth, id, score, place): the k best of each anchor and nth over all blocks."""
    a, r = groups.dealt(anchors, rows, space)
    keys = ["group", "part", "block"]
    partial = a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_joined(space, search), "anchor bigint, akey bigint, nth int, id bigint, score bigint")
    order = Window.partitionBy("anchor", "akey", "nth").orderBy(F.desc("score"), "id")
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, label_col: str = "label", vector_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors: rows where ``anchor``, an expression of column ``id``, holds.  An anchor's positives are
    its first ``positives`` rows of its label with another id, by (score downwards, id); for each the
    first ``negatives`` rows of other labels with a score of ``low`` to ``high`` per cent of the
    positive's.  Rows without id, label or vector, or with a null or non-finite component, take no
    part; repeated rows count once, different rows under one id are items each.  No rows, no
    anchors or negative scores alone give no result.
    """
    spark = vectors.sparkSession
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    given = prepared(vectors, label_col, vector_col, id_col, scale)
    made = assigned(given, given.where(anchor).count())
    if made is None:
        return spark.createDataFrame([], result)
    rows, space = made
    key = F.xxhash64("id", "label", "v").alias("akey")
    anchors = shared.stage(rows.where(anchor).select("id", "label", "v", key), "neighbour-anchors")
    histogram = Histogram(rows, space)
    square = space.square

    def near(b, to):
        # the anchor's own rows may be among those counted: one more is asked for
        reach = np.array([histogram.within(x, to[i], positives + 1) for i, x in enumerate(b.column("label").to_pylist())])
        return to - reach[:, None], to + reach[:, None]

    def of_label(scores, same, aid, rid, more, lowest):
        yield (0, *best(np.where(same & (aid[:, None] != rid), scores, scores.dtype.type(lowest)), rid, positives))

    own = shared.stage(_met(anchors, rows, Groups(anchors, space, histogram, near), space, of_label, positives), "neighbour-positives")
    # the window of integer scores below each positive; a negative positive's is empty
    exact = own.withColumns({"floor": F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100"), "top": F.expr(f"score div 100 * {high} + score % 100 * {high} div 100")}).where("score >= 0 AND floor <= top")
    windows = exact.groupBy("anchor", "akey").agg(F.array_sort(F.collect_list(F.struct("place", "floor", "top"))).alias("w"))
    seeking = windows.select(F.col("anchor").alias("id"), "akey", F.transform("w", lambda w: w["place"]).alias("places"), F.transform("w", lambda w: w["floor"]).alias("floors"), F.transform("w", lambda w: w["top"]).alias("tops"))
    seekers = shared.stage(anchors.join(seeking, ["id", "akey"]), "neighbour-seekers")

    def between(b, to):
        norm = (matrix(b.column("v"), space.width) ** 2).sum(1)
        floors, tops = (np.array([pick(x) for x in b.column(c).to_pylist()], float) for c, pick in (("floors", min), ("tops", max)))
        outer, inner = (np.sqrt(np.maximum(norm + square - 2 * x, 0))[:, None] for x in (floors, tops))
        return np.maximum(to - outer, inner - to), to + outer

    def of_others(scores, same, aid, rid, more, lowest):
        places, floors, tops = (more.column(c).to_pylist() for c in ("places", "floors", "tops"))
        for nth in range(1, positives + 1):
            have = [i for i, p in enumerate(places) if nth in p]
            if have:
                at = [places[i].index(nth) for i in have]
                bounds = [np.array([of[i][a] for i, a in zip(have, at, strict=True)], scores.dtype)[:, None] for of in (floors, tops)]
                there = scores[have]
                row, col = best(np.where(~same[have] & (there >= bounds[0]) & (there <= bounds[1]), there, scores.dtype.type(lowest)), rid, negatives)
                yield nth, np.array(have)[row], col

    others = _met(seekers, rows, Groups(seekers, space, histogram, between), space, of_others, negatives)
    named = own.select("anchor", "akey", F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = others.join(named, ["anchor", "akey", "nth"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows by all products of anchors and rows.
MINE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM s WHERE same) WHERE nth <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
