"""Source-agnostic results and link lists, relational over anchors of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, dates, urls
from ..functions.dialect import SPARK

NAV_TEXT = "(?i)^(首页|网站首页|登录|注册|搜索|更多|全部|返回|下一页|上一页|关于我们|联系我们|English|手机版|客户端|APP|版权|免责声明|隐私政策|网站地图|RSS|帮助|客服|read\\s*more|more)$"


def generic_results(anchors: DataFrame, excluded_hosts: list[str] | None = None) -> DataFrame:
    """(page_id, pos, title, url, desc): the links of a page's dominant structure.

    Links group by the tags around them; groups of three or more with readable titles compete by
    size, described share and variety of hosts; URLs count once.
    """
    own = anchors.withColumn("host", F.regexp_replace(col(urls.host, "href"), r"^www\.", ""))
    own = own.where("href rlike '^(?i)https?://' AND length(title) BETWEEN 5 AND 120")
    if excluded_hosts:
        own = own.where(~F.col("host").isin(excluded_hosts))
    groups = own.groupBy("page_id", "sig").agg(F.count("*").alias("n"), (F.count_distinct("host") / F.count("*")).alias("variety"), F.avg((~F.col("title").rlike("(?i)https?:")).cast("double")).alias("readable"), F.avg((F.length("desc") >= 20).cast("double")).alias("described"))
    best = Window.partitionBy("page_id").orderBy(F.desc("n"), F.desc("described"), F.desc("variety"), "sig")
    best = groups.where("n >= 3 AND readable >= 0.6").withColumn("nth", F.row_number().over(best)).where("nth = 1").select("page_id", "sig")
    first = Window.partitionBy("page_id", "href").orderBy("pos")
    return own.join(best, ["page_id", "sig"]).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("page_id", "pos", "title", F.col("href").alias("url"), "desc")


def link_list(anchors: DataFrame) -> DataFrame:
    """(page_id, place, title, url, date, score): article links outside navigation, dated ones first."""
    a = anchors.where("NOT nav AND length(title) BETWEEN 5 AND 80").where(~F.col("title").rlike(NAV_TEXT)).where("href rlike '^(?i)https?://'")
    a = a.withColumn("url", F.regexp_replace("href", "#.*$", "")).withColumn("score", col(urls.article_score, "url")).where("score >= 1")
    for key in (F.regexp_replace("url", "/$", ""), F.regexp_replace("title", r"[\s\x{3000}]+", "")):
        a = a.withColumn("k", key).withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "k").orderBy("pos"))).where("nth = 1").drop("k", "nth")
    a = a.withColumn("date", F.expr(f"coalesce(nullif(near_date, ''), nullif({dates.url_date(SPARK, 'url')}, ''))"))
    order = Window.partitionBy("page_id").orderBy(F.desc_nulls_last("date"), "pos")
    return a.withColumn("place", F.row_number().over(order)).select("page_id", "place", "title", "url", "date", "score")


def parse_tier(counts: DataFrame) -> DataFrame:
    """With parsed_by from (specific, generic, stream, entries, limit): which parser's rows to use."""
    rate = F.col("specific") / F.greatest(F.lit(1), F.least("limit", F.coalesce("entries", "limit")))
    s, g = F.col("specific"), F.col("generic")
    tier = F.when((s > 0) & (rate >= 0.5), "specific").when((s >= 5) & (s >= g), "specific").when(g > s, "generic").when(s > 0, "specific").when(F.col("stream") > 0, "urlstream").otherwise("none")
    return counts.withColumn("hit_rate", rate).withColumn("parsed_by", tier)
