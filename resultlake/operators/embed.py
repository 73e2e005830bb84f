"""Embeddings without a model: hashed tokens as vectors, and likeness of token sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import DUCK, SPARK, Dialect
from ..staging import staged

DIMENSIONS = 256
# Fixed values that results depend on: likeness at which results are of one subject, by backend.
THRESHOLDS = {"api": 0.5, "local": 0.55}


def threshold(backend: str, named: float | None = None) -> float:
    """The clustering threshold of an embedding backend, unless one is named."""
    return named if named is not None else THRESHOLDS["api" if backend == "api" else "local"]


def tokens(d: Dialect, s: str) -> str:
    return d.distinct(d.chain(text.grams(d, s, 2), text.words_mixed(d, s)))


def likeness(d: Dialect, a: str, b: str) -> str:
    """Cosine of two arrays of distinct tokens; null if either is empty."""
    both = d.size(f"{'array' if d.spark else 'list'}_intersect({a}, {b})")
    return f"CASE WHEN {d.size(a)} > 0 AND {d.size(b)} > 0 THEN {both} / sqrt(CAST({d.size(a)} AS DOUBLE) * {d.size(b)}) END"


def hashed(rows: DataFrame, text_col: str = "text", id_col: str = "id", dimensions: int = DIMENSIONS) -> DataFrame:
    """(``id_col``, vec): signed hashed tokens, of length 1; texts without tokens have none."""
    each = rows.select(id_col, F.explode(F.expr(tokens(SPARK, text_col))).alias("token"))
    h = F.xxhash64("token")
    sums = each.groupBy(id_col, F.pmod(h, F.lit(dimensions)).cast("int").alias("at")).agg(F.sum(F.when(h < 0, -1.0).otherwise(1.0)).alias("x"))
    maps = sums.where("x <> 0").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return maps.select(id_col, F.expr(f"transform(sequence(0, {dimensions - 1}), k -> coalesce(try_element_at(m, k), 0D) / n)").alias("vec"))


#: Buckets that tokens' document frequencies are counted in, and dimensions of a projection (bits of a token's hash).
FREQUENCY_BUCKETS, PROJECTED = 1 << 16, 64


def _bits(d: Dialect, token: str, part: int) -> str:
    """32 bits of a token's hash."""
    return d.from_hex(f"substr(md5({token}), {8 * part + 1}, 8)")


def projected(rows: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(``id_col``, v): random projection of the distinct tokens' inverse document frequencies.

    Cosines of projections estimate those of the weighted token sets, with a deviation of 1/8 about
    0.  A token's direction is the signs of its hash; frequencies are counted in FREQUENCY_BUCKETS,
    which come to the driver and go to all tasks.  Texts without tokens have no row; rows under one id are one text.
    """
    told = rows.agg(F.count_distinct(id_col).alias("n"), F.max(F.col(id_col).isNull().cast("int")).alias("none"), F.count("*").alias("rows")).first()
    n = told["n"] + (told["none"] or 0)
    hashes = F.expr(f"transform({tokens(SPARK, text_col)}, t -> substr(md5(t), 1, 16))")
    own = rows.select(id_col, hashes.alias("h")).select(id_col, *(F.expr(f"transform(h, x -> CAST(conv(substr(x, {8 * k + 1}, 8), 16, 10) AS BIGINT))").alias(c) for k, c in enumerate("ab")))
    own = staged(own, "tokens").where("size(a) > 0")  # read twice: for frequencies, then for sums
    counts = own.select(F.explode("a").alias("a")).groupBy((F.col("a") % FREQUENCY_BUCKETS).alias("bucket")).agg(F.count("*").alias("df")).toArrow()
    often = np.zeros(FREQUENCY_BUCKETS)
    often[counts.column("bucket").to_numpy()] = counts.column("df").to_numpy()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.log(1 + n / np.maximum(often, 1))
        for batch in batches:
            lengths = pc.list_value_length(batch.column("a")).to_numpy()
            if len(lengths):
                a, b = (batch.column(c).flatten().to_numpy() for c in "ab")
                w, begins = weights[a % FREQUENCY_BUCKETS], np.concatenate([[0], np.cumsum(lengths)[:-1]])
                v = np.stack([np.add.reduceat(w * (1 - 2 * ((a if k < 32 else b) >> k % 32 & 1)), begins) for k in range(PROJECTED)], axis=1)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, PROJECTED), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), values], [id_col, "v"])

    each = own.mapInArrow(sums, f"`{id_col}` {dict(rows.dtypes)[id_col]}, v array<double>")
    if told["rows"] == n:
        return each
    at = lambda vs: F.aggregate(F.slice(vs, 2, F.greatest(F.lit(0), F.size(vs) - 1)), F.get(vs, 0), lambda t, v: F.zip_with(t, v, lambda x, y: x + y))
    return each.groupBy(id_col).agg(F.collect_list("v").alias("vs")).select(id_col, at(F.col("vs")).alias("v"))


def projected_sql(table: str, id_col: str, text_col: str) -> str:
    """The same rows in DuckDB."""
    d = DUCK
    sums = ", ".join(f"sum(w * (1 - 2 * (({'a' if k < 32 else 'b'} >> {k % 32}) & 1)))" for k in range(PROJECTED))
    each = f"SELECT {id_col}, {_bits(d, 'token', 0)} AS a, {_bits(d, 'token', 1)} AS b FROM (SELECT {id_col}, unnest({tokens(d, text_col)}) AS token FROM {table})"
    return (
        f"SELECT {id_col}, [{sums}] AS v FROM (SELECT e.*, ln(1 + (SELECT count(DISTINCT {id_col}) FROM {table})::DOUBLE / df) AS w FROM ({each}) e "
        f"JOIN (SELECT a % {FREQUENCY_BUCKETS} AS bucket, count(*) AS df FROM ({each}) GROUP BY 1) f ON f.bucket = e.a % {FREQUENCY_BUCKETS}) GROUP BY {id_col}"
    )


def covered(rows: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """``rows`` with ``rel``: the share of its query's token weight that a row's text holds; null without query tokens.

    A token weighs its inverse document frequency among the rows, counted in FREQUENCY_BUCKETS.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FREQUENCY_BUCKETS))
    told = rows.withColumn("__t", F.expr(tokens(SPARK, text_col)))
    n = rows.count()
    often = told.select(F.explode("__t").alias("t")).groupBy(bucket("t").alias("b")).agg(F.count("*").alias("df"))
    asked = rows.select(query_col).distinct().withColumn("q", F.explode_outer(F.expr(tokens(SPARK, query_col)))).withColumn("b", bucket("q"))
    weighed = asked.join(F.broadcast(often), "b", "left").withColumn("w", F.log(1 + n / F.greatest(F.lit(1), F.coalesce("df", F.lit(1)))))
    listed = weighed.groupBy(query_col).agg(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("q", "w"))).alias("__q"))
    total = lambda xs: f"aggregate({xs}, 0D, (s, x) -> s + x.w)"
    rel = F.expr(f"CASE WHEN size(__q) > 0 THEN {total('filter(__q, x -> array_contains(__t, x.q))')} / {total('__q')} END")
    return told.join(listed.withColumnRenamed(query_col, "__asked"), F.col(query_col).eqNullSafe(F.col("__asked")), "left").withColumn("rel", rel).drop("__t", "__q", "__asked")
