"""News lists of official sites, query relaxation, and how results and lists are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.dialect import SPARK

DAYS = 30


def news(links: DataFrame, as_of: str, limit: int = 99) -> DataFrame:
    """(query_id, place, title, url, date): links whose title has a word of the query, newest first.

    ``links`` (query_id, query, pos, title, url): titles of eight characters or more within DAYS
    days; a URL counts once, and so does a title's first 24 characters without punctuation.
    """
    day = F.expr(f"coalesce(nullif({dates.url_date(SPARK, 'url')}, ''), nullif({dates.absolute(SPARK, 'title')}, ''))")
    words = F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 0)
    own = links.where("length(title) >= 8").withColumn("date", day).where(F.exists(words, lambda w: F.contains(F.lower("title"), F.lower(w))))
    own = own.where(F.col("date").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.expr("try_cast(date AS date)")) <= DAYS))
    order = [F.desc_nulls_last("date"), F.col("pos")]
    own = own.withColumn("title_key", F.substring(F.regexp_replace("title", r"[\s\p{P}]+", ""), 1, 24))
    for key in ("url", "title_key"):
        own = own.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))).where("nth = 1").drop("nth")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return own.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "title", "url", "date")


def relaxed(answers: DataFrame) -> DataFrame:
    """(query_id, words): the longest prefix of a query that has rows; ``answers`` (query_id, words, n)."""
    return answers.where("n > 0").groupBy("query_id").agg(F.max("words").alias("words"))


def prefixes(queries: DataFrame) -> DataFrame:
    """(query_id, words, prefix): a query's prefixes by whole words, to be asked from the longest on."""
    words = F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 0)
    each = queries.withColumn("ws", words).where(F.size("ws") > 0).select("query_id", "ws", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("words"))
    return each.select("query_id", "words", F.array_join(F.slice("ws", 1, F.col("words")), " ").alias("prefix"))


def shown(results: DataFrame) -> DataFrame:
    """With show_url and show_desc: rows of low relevance or spam show a title alone.

    Other low-quality rows show their URL; edge rows 120 characters of the description.
    """
    spam = F.exists("flags", lambda f: f.startswith("low:spam"))
    low = F.exists("flags", lambda f: f.startswith("low:") & (f != "low:stale"))
    bare = F.coalesce(F.col("low_relevance"), F.lit(False)) | spam
    desc = F.when(bare | low, "").when(F.col("tier") == "edge", F.substring("desc", 1, 120)).otherwise(F.col("desc"))
    return results.withColumn("show_url", ~bare).withColumn("show_desc", desc)


def list_body(items: DataFrame) -> DataFrame:
    """(page_id, body, newest, dated): a link list as text; dates lead where 40 % of items have one."""
    share = F.avg(F.col("date").isNotNull().cast("double")).over(Window.partitionBy("page_id")) >= 0.4
    line = F.when(F.col("lead") & F.col("date").isNotNull(), F.concat_ws(" ", "date", "title")).otherwise(F.col("title"))
    rows = items.withColumn("lead", share).withColumn("line", line)
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"), F.max("date").alias("newest"), F.count("date").alias("dated"))
