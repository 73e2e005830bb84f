"""Relations of this package from stored tables: result lists, pages, contents, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPARK

#: Sources that stored pages are dealt to, queries that each PAGES of them are dealt to, where they don't name their own.
QUERIES, SOURCES, PAGES = 10, 4, 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def result_lists(pages: DataFrame) -> DataFrame:
    """(query_id, query, src, src_order, pos, page_id, title, url, desc, date, is_ad) from stored pages.

    Every third page also appears in a second source under a variant of its URL.  Queries grow in
    number with the pages, not their lists; they are empty until ``asked`` names them.
    """
    number = (F.floor(F.col("page_id") / PAGES) * QUERIES + F.col("page_id") % QUERIES).cast("bigint")
    title = F.expr(text.clean(SPARK, "regexp_extract(html, r'(?is)<title[^>]*>(.*?)</title>', 1)"))
    desc = F.expr(f"substr({text.strip_tags(SPARK, 'regexp_extract(html, r' + chr(34) + '(?is)<p[^>]*>(.*?)</p>' + chr(34) + ', 1)')}, 1, 160)")
    base = pages.select("page_id", number.alias("query_id"), (F.col("page_id") % SOURCES).alias("src_order"), "url", title.alias("title"), desc.alias("desc"))
    again = F.expr("concat(regexp_replace(url, '^https?://', 'https://www.'), CASE WHEN url LIKE '%?%' THEN '&' WHEN url LIKE '%#%' THEN '' ELSE '?' END, CASE WHEN url LIKE '%#%' THEN '' ELSE 'utm_source=x' END)")
    # one row becomes two, so that a page is parsed once
    own, second = F.struct("src_order", "url"), F.struct(F.lit(9).cast("bigint").alias("src_order"), again.alias("url"))
    each = base.withColumn("at", F.explode(F.when(F.col("page_id") % 3 == 0, F.array(own, second)).otherwise(F.array(own))))
    both = each.select("page_id", "query_id", "at.src_order", "at.url", "title", "desc").withColumn("src", F.concat(F.lit("e"), "src_order"))
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("page_id")))
    return both.withColumn("date", F.lit(None).cast("string")).withColumn("is_ad", F.lit(False)).withColumn("query", F.lit(""))


def asked(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """``lists`` with the texts of their queries; ``queries`` (query_id below QUERIES, query) repeat."""
    texts = queries.select(F.col("query_id").alias("__of"), "query")
    return lists.drop("query").withColumn("__of", F.col("query_id") % QUERIES).join(F.broadcast(texts), "__of", "left").drop("__of").withColumn("query", F.coalesce("query", F.lit("")))


def title_queries(lists: DataFrame) -> DataFrame:
    """(query_id, query): for each query number words of the title of one of its pages (page_id, title), so that its list has answers."""
    words = F.slice(F.filter(F.split("title", "[^\\p{L}]+"), lambda w: F.length(w) > 3), 1, 4)
    own = lists.select((F.col("page_id") % QUERIES).alias("query_id"), "page_id", F.array_join(words, " ").alias("query")).where("query <> ''")
    return own.groupBy("query_id").agg(F.min_by("query", "page_id").alias("query"))


def contents(documents: DataFrame) -> DataFrame:
    """(doc_id, title, body): a document's first 60 characters of its first line, and its text."""
    return documents.select("doc_id", F.expr("substr(split(text, '\\n')[0], 1, 60)").alias("title"), F.col("text").alias("body"))


def observations(events: DataFrame) -> DataFrame:
    """(key, id, at, kind, value) of reputation from an event table."""
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "purchase", "content").when(F.col("event_type") == "click", "select").otherwise("fetch")
    value = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "signup", 1.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100))
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"), value.alias("value"))
