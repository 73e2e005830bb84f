"""Relevance grades of clusters and how they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEVANT_LEAST, RELEVANT_SHARE, EDGE_LEAST, EDGE_SHARE, TEXT_HIT = 0.5, 0.6, 0.25, 0.4, 0.5


def graded(clusters: DataFrame, mode: str = "balanced") -> DataFrame:
    """With edge, irrelevant (thresholds from the best score of the query), grade and tier.

    ``mode``: aggressive folds edge clusters too, conservative shows all.
    """
    top = F.greatest(F.lit(0.0), F.max("sem_score").over(Window.partitionBy("query_id")))
    out = clusters.withColumn("edge", F.greatest(F.lit(RELEVANT_LEAST), top * RELEVANT_SHARE)).withColumn("irrelevant", F.greatest(F.lit(EDGE_LEAST), top * EDGE_SHARE))
    grade = F.when(F.col("sem_score").isNull(), "unscored").when(F.col("sem_score") >= F.col("edge"), "relevant").when(F.col("sem_score") >= F.col("irrelevant"), "edge").otherwise("irrelevant")
    out = out.withColumn("grade", grade)
    any_score = F.max(F.col("sem_score").isNotNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    shown = F.lit(mode == "conservative") | ~any_score | (F.col("grade") == "relevant")
    return out.withColumn("tier", F.when(shown, "shown").when((F.col("grade") == "edge") & F.lit(mode != "aggressive"), "edge").otherwise("collapsed"))


def reasons(graded_: DataFrame) -> DataFrame:
    """With the reason why a cluster is of little relevance, and its score to two decimals."""
    text = F.when(F.col("text_score") >= TEXT_HIT, "标题/摘要含查询词但语义无关").otherwise("与查询主题无明显语义关联")
    score = F.coalesce(F.format_string("%.2f", "sem_score"), F.lit("?"))
    return graded_.withColumn("reason", F.concat(text, F.lit("(语义 "), F.when(F.col("sem_score").isNull(), "?").otherwise(score), F.lit(")")))


def low_members(members: DataFrame) -> DataFrame:
    """(query_id, cluster_id, size, low): members of a cluster, and those with a low-quality flag."""
    low = F.exists("flags", lambda f: f.startswith("low:")).cast("bigint")
    return members.groupBy("query_id", "cluster_id").agg(F.count("*").alias("size"), F.sum(low).alias("low"))


def tier_totals(graded_: DataFrame) -> DataFrame:
    """(query_id, tier, clusters, results)."""
    return graded_.groupBy("query_id", "tier").agg(F.count("*").alias("clusters"), F.sum("size").alias("results"))


def markdown(graded_: DataFrame) -> DataFrame:
    """(query_id, markdown): shown and edge clusters as headings in order, collapsed ones on one line."""
    own = Window.partitionBy("query_id").orderBy("cluster_id")
    line = F.when(F.col("tier") == "collapsed", None).otherwise(F.concat(F.lit("## "), "label", F.lit(" ("), "size", F.lit(")")))
    heads = graded_.withColumn("nth", F.row_number().over(own)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("nth", line.alias("t"))))).alias("all"))
    joined = heads.select("query_id", F.array_join(F.col("all.t"), "\n").alias("top")).join(brief(graded_), "query_id", "left")
    return joined.select("query_id", F.concat("top", F.coalesce(F.concat(F.lit("\n> "), "brief"), F.lit(""))).alias("markdown"))


def brief(graded_: DataFrame) -> DataFrame:
    """(query_id, brief): labels and sizes of collapsed clusters in order of cluster_id."""
    each = F.struct("cluster_id", F.concat(F.lit("["), "label", F.lit("]×"), "size").alias("t"))
    lists = graded_.where("tier = 'collapsed'").groupBy("query_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    return lists.select("query_id", F.array_join(F.col("all.t"), " · ").alias("brief"))


def rerank(results: DataFrame) -> DataFrame:
    """With place by query: cosine to the query (0 at least) descending, stable."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.greatest(F.lit(0.0), "rel")), "idx")))
