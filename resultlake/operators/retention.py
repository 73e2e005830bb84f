"""Retention of ledgers and models: what stays when a bound is passed, as ranked filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRIES, WEIGHTS, VERDICTS, TOKENS, EVENTS = 5000, 6000, 2000, 20_000, 2000


def newest(rows: DataFrame, order: list[Column], keep: int, by: list[str]) -> DataFrame:
    """The ``keep`` last rows of each group ``by`` in a total order; a group is bounded by its model."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")


def halved(rows: DataFrame, order: list[Column], bound: int, by: list[str]) -> DataFrame:
    """Groups of more than ``bound`` rows lose the older half of the bound."""
    own = Window.partitionBy(*by)
    ranked = rows.withColumn("n", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy(*order)))
    return ranked.where((F.col("n") <= bound) | (F.col("nth") > bound // 2)).drop("n", "nth")


def trimmed(tokens: DataFrame, bound: int, by: list[str]) -> DataFrame:
    """Token counts of groups over ``bound``: the most counted 90 % of the bound stay."""
    own = Window.partitionBy(*by)
    ranked = tokens.withColumn("kinds", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc(F.col("good") + F.col("bad")), "token")))
    return ranked.where((F.col("kinds") <= bound) | (F.col("nth") <= int(bound * 0.9))).drop("kinds", "nth")
