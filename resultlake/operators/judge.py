"""Relevance judgements of outside models: batching, caching, neutral values, and learning from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, NEUTRAL, TTL_DAYS = 12, 0.5, 30


def shards(results: DataFrame) -> DataFrame:
    """With shard: which request a result goes into, SHARD results each, by query in order of idx."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("idx"))
    return results.withColumn("shard", F.floor((nth - 1) / SHARD))


def cache_key(*parts: Column) -> Column:
    """Key of a judged text: a hash over its parts, told apart."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts)))


def judged(results: DataFrame, scores: DataFrame, as_of: str) -> DataFrame:
    """With judge_score and judged: the newest score of the URL within TTL_DAYS, else the neutral value."""
    fresh = scores.where(F.datediff(F.lit(as_of).cast("date"), F.col("at").cast("date")).between(0, TTL_DAYS))
    newest = fresh.groupBy("url").agg(F.max_by("score", "at").alias("s"))
    joined = results.join(newest, "url", "left")
    return joined.withColumn("judge_score", F.coalesce("s", F.lit(NEUTRAL))).withColumn("judged", F.col("s").isNotNull()).drop("s")


def refreshes(results: DataFrame) -> DataFrame:
    """Results worth judging: sites of fewer than three samples, and about one URL in twenty of the rest."""
    lot = F.conv(F.substring(F.sha2("url", 256), 1, 2), 16, 10).cast("int") < 13
    return results.where((F.coalesce("samples", F.lit(0)) < 3) | lot)


def contribution(title_score: Column, body_score: Column) -> Column:
    """Reputation from badness scores of title and body: the worse one decides."""
    worst = F.greatest(title_score, body_score)
    return F.when(worst >= 0.65, 0.1).when(worst >= 0.35, 0.5).otherwise(0.95)
