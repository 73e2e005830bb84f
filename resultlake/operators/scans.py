"""Ordered histories as associative scans: folds and as-of values of keys that no one task holds.

A key's history is cut into pieces by order, folded piece by piece into maps that compose, and the
maps are composed in a tree.  A key with most of all rows is many pieces like any other; what
meets in one place is a piece of PIECE rows, about, or FAN maps.  Everything is built-in
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Rows of a piece, about, and maps that are composed at once.
PIECE, FAN = 20_000, 1_000


def pieces(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` staged with ``piece``: pieces go up in (keys, order), so a key's pieces are in its order.

    Dealt by ranges of keys and order together, which cut within a key.
    """
    n = max(1, -(-rows.count() // PIECE))
    dealt = rows.repartitionByRange(n, *keys, *order) if n > 1 else rows.coalesce(1)
    return staged(dealt.withColumn("piece", F.spark_partition_id()), "pieces")


def counted_before(counts: DataFrame, keys: list[str], of: str = "n") -> DataFrame:
    """``counts`` (keys, piece, ``of``) with ``before``: what a key's earlier pieces count; a row a piece."""
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(of).over(earlier), F.lit(0)))


def composed(maps: DataFrame, keys: list[str], compose: Callable[[Column, Column], Column], of: str = "map") -> DataFrame:
    """(keys, ``of``): the maps (keys, piece, ``of``) of each key composed in order of piece.

    ``compose(first, then)`` is associative.  FAN neighbouring pieces at a time, until one is left.
    """
    top, level = maps.agg(F.max("piece")).first()[0] or 0, maps.select(*keys, "piece", of)
    while True:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.col(of).alias("m")))), lambda p: p["m"])
        level = level.groupBy(*keys, F.floor(F.col("piece") / FAN).cast("int").alias("run")).agg(listed.alias("maps"))
        level = level.select(*keys, F.col("run").alias("piece"), F.aggregate(F.slice("maps", 2, FAN), F.get("maps", 0), compose).alias(of))
        if top < FAN:
            return level.drop("piece")
        top //= FAN


# --- s -> min(high, max(low, a s + b)), a >= 0 -------------------------------------------------


def line(a: Column, b: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def line_then(f: Column, g: Column) -> Column:
    """The map that does f, then g."""
    bound = lambda x: F.least(g["high"], F.greatest(g["low"], g["a"] * x + g["b"]))
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"))


def line_at(f: Column, s: float) -> Column:
    return F.least(f["high"], F.greatest(f["low"], f["a"] * s + f["b"]))


# --- values as of a time ----------------------------------------------------------------------


def as_of(asked: DataFrame, facts: DataFrame, value: str, key: str = "key", at: str = "at", name: str = "found") -> DataFrame:
    """``asked`` with ``name``: struct (at, value) of its key's newest fact at or before its time; null without one.

    ``facts`` (``key``, ``at``, ``value``); of facts at one time the greatest value counts.  Rows with
    a null key or time find nothing, facts with one are never found.  Both sides are dealt together
    by ranges of key and time; a piece knows the newest fact of the pieces before it.
    """
    fact = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    known = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__asked"), fact.alias("__fact"))
    whole = [c for c in asked.columns]
    wanted = asked.select(F.struct(*whole).alias("__row"), F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__asked"))
    both = wanted.unionByName(known, allowMissingColumns=True).withColumn("__value", F.col("__fact.value"))
    dealt = pieces(both, ["__key"], ["__at", "__asked", "__value"])
    within = Window.partitionBy("__key", "piece").orderBy("__at", "__asked", "__value").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where("__asked = 0").groupBy("__key", "piece").agg(F.max("__fact").alias("__newest"))
    held = dealt.select("__key", "piece").distinct().join(last, ["__key", "piece"], "left")
    earlier = Window.partitionBy("__key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.withColumn("__carried", F.last("__newest", ignorenulls=True).over(earlier)).select("__key", "piece", "__carried").where("__carried IS NOT NULL")
    here = dealt.withColumn("__here", F.last("__fact", ignorenulls=True).over(within)).where("__asked = 1")
    out = here.join(carried, ["__key", "piece"], "left")
    found = F.when(F.col("__key").isNotNull() & F.col("__at").isNotNull(), F.coalesce("__here", "__carried"))
    return out.select("__row.*", found.alias(name))
