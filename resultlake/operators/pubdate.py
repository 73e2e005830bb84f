"""Publish dates of pages: candidates by rule family, page features, and adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.dialect import SPARK

# Fixed values that results depend on: priors of the two logistic models.
LIST_WEIGHTS = {"link_density": 0.6, "has_article": -1.0, "body_short": 0.4, "body_med": -0.2, "title_channel": 0.5, "meta_url_conflict": 0.6, "ts_stream": 0.7}
LIST_BIAS = -0.5
SOURCE_WEIGHTS = {"meta-article": 0.7, "jsonld": 0.55, "list-time": 0.45, "url": 0.35, "body-ctx": 0.25, "js-var": 0.15, "meta-generic": 0.1}
STRONG, LIST_PENALTY, URL_CONFLICT, CANDIDATE_BIAS = 0.4, -1.2, -0.9, 0.1
META_ARTICLE = "article:published_time|article:modified_time|og:updated_time|datepublished|datecreated|datemodified"
META_GENERIC = "date|pubdate|publishdate|publish-date|parsely-pub-date|dc.date|dcterms.created|dcterms.date"
CHANNEL = "(?i)频道|滚动|列表|首页|栏目|热点|新闻|直播|快讯|channel|news|index|archive|list"
SEPARATED = r"20\d{2}[年/.-]?\d{1,2}[月/.-]?\d{1,2}[日]?"


def _tags(names: str) -> str:
    """Whole meta elements of these names, their attributes in any order."""
    return f"regexp_extract_all(html, r'(?i)<meta[^>]+(?:property|name|itemprop)=[\"\\x27](?:{names})[\"\\x27][^>]*>', 0)"


def _content(tag: str) -> str:
    return f"regexp_extract({tag}, r'(?i)content=[\"\\x27]([^\"\\x27]*)', 1)"


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, pos, date, source, strong): distinct (date, source) in order of the rule families."""
    meta = lambda names: f"transform({_tags(names)}, tag -> {_content('tag')})"
    ld = "regexp_extract_all(html, r'\"(?:datePublished|dateCreated|uploadDate|dateModified)\"\\s*:\\s*\"([^\"]+)\"', 1)"
    js = "regexp_extract_all(html, r'(?i)(?:publishTime|pubDate|createTime|createdAt|issueDate|releaseDate|showTime|pub_time)\\s*[:=]\\s*[\"\\x27]?(20\\d{2}[-/.]\\d{1,2}[-/.]\\d{1,2})', 1)"
    body = f"slice(regexp_extract_all(html, r'(?i)(?:发布时间|更新时间|发布于|发表于|刊发时间|编辑时间|日期)[:：]?\\s*({SEPARATED})', 1), 1, 3)"
    times = "slice(concat(regexp_extract_all(html, r'(?i)<time[^>]+datetime=[\"\\x27]([^\"\\x27]*)', 1), regexp_extract_all(html, r'(?i)class=[\"\\x27][^\"\\x27]*(?:time|date)[^\"\\x27]*[\"\\x27][^>]*>([^<]{1,30})<', 1)), 1, 15)"
    families = [("meta-article", meta(META_ARTICLE), False), ("meta-generic", meta(META_GENERIC), False), ("jsonld", ld, False), ("url", "array(coalesce(url, ''))", False), ("js-var", js, False), ("body-ctx", body, True), ("list-time", times, False)]
    structs = ", ".join(f"transform({e}, t -> named_struct('text', t, 'source', '{s}', 'strong', {str(strong).lower()}))" for s, e, strong in families)
    each = pages.select("page_id", F.posexplode(F.expr(f"concat({structs})")).alias("pos", "c")).select("page_id", "pos", "c.*")
    day = F.expr(f"CASE WHEN source = 'url' THEN {dates.url_date(SPARK, 'text')} ELSE {dates.absolute(SPARK, 'text')} END")
    dated = each.withColumn("date", day).where("date <> ''")
    return dated.groupBy("page_id", "date", "source").agg(F.min("pos").alias("pos"), F.max("strong").alias("strong"))


def features(pages: DataFrame) -> DataFrame:
    """(page_id, features of a page, list_prob) from (page_id, html, title, body_len) and, if there, url."""
    days = f"filter(transform({_tags('article:published_time|datepublished|date')}, tag -> {dates.absolute(SPARK, _content('tag'))}), t -> t <> '')"
    url = "coalesce(url, '')" if "url" in pages.columns else "''"
    apart = f"coalesce(abs(datediff(try_cast(get({days}, 0) AS date), try_cast({dates.url_date(SPARK, url)} AS date))) > 30, false)"
    density = "least(2D, size(regexp_extract_all(html, r'(?i)<a\\s[^>]*href', 0)) / greatest(1D, greatest(1, length(regexp_replace(regexp_replace(html, r'(?is)<(script|style).*?</(script|style)>', ' '), r'<[^>]+>', ' '))) / 1000D))"
    flag = lambda e: F.expr(f"CASE WHEN {e} THEN 1D ELSE 0D END")
    f = pages.select(
        "page_id", F.expr(density).alias("link_density"), flag("regexp_like(html, r'(?i)<(article|main)[\\s>]')").alias("has_article"), flag("body_len < 220").alias("body_short"),
        flag("body_len >= 220 AND body_len < 1200").alias("body_med"), flag(f"regexp_like(coalesce(title, ''), r'{CHANNEL}')").alias("title_channel"), flag(apart).alias("meta_url_conflict"),
        flag("size(regexp_extract_all(html, r'20\\d{2}[-/]\\d{1,2}[-/]\\d{1,2}\\s+\\d{1,2}:\\d{2}', 0)) >= 3").alias("ts_stream"),
    )
    z = sum((F.col(k) * w for k, w in LIST_WEIGHTS.items()), F.lit(LIST_BIAS))
    return f.withColumn("list_prob", 1 / (1 + F.exp(-z)))


def pick(candidates_: DataFrame, features_: DataFrame) -> DataFrame:
    """(page_id, date, source, confidence, is_list): one row a page of ``features_``."""
    own = Window.partitionBy("page_id")
    url_day = F.max(F.when(F.col("source") == "url", F.col("date"))).over(own)
    c = candidates_.join(features_.select("page_id", "list_prob"), "page_id").withColumn("url_day", url_day)
    weight = F.coalesce(*(F.when(F.col("source") == s, F.lit(w)) for s, w in SOURCE_WEIGHTS.items()))
    is_meta = F.col("source").startswith("meta-")
    apart = F.abs(F.datediff(F.expr("try_cast(date AS date)"), F.expr("try_cast(url_day AS date)"))) > 30
    z = weight + F.when(F.col("strong"), STRONG).otherwise(0.0) + F.when(is_meta & (F.col("list_prob") > 0.3), LIST_PENALTY * F.col("list_prob")).otherwise(0.0)
    z = z + F.when((F.col("source") != "url") & F.coalesce(apart, F.lit(False)), URL_CONFLICT).otherwise(0.0) + CANDIDATE_BIAS
    c = c.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("n", F.count("*").over(own)).withColumn("all_meta", F.min(is_meta.cast("int")).over(own) == 1)
    best = c.withColumn("nth", F.row_number().over(own.orderBy(F.desc("score"), "pos"))).where("nth = 1")
    sure = (F.col("n") == 1) & F.col("source").isin("meta-article", "jsonld") & (F.col("list_prob") < 0.45)
    refused = (F.col("list_prob") > 0.55) & F.col("all_meta")
    best = best.select("page_id", F.when(refused, "").otherwise(F.col("date")).alias("date"), F.when(refused, "none").otherwise(F.col("source")).alias("source"), F.when(refused, 0.0).when(sure, 0.9).otherwise(F.col("score")).alias("confidence"))
    out = features_.select("page_id", (F.col("list_prob") > 0.55).alias("is_list")).join(best, "page_id", "left")
    return out.select("page_id", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "is_list")


def consensus(candidates_: DataFrame) -> DataFrame:
    """(page_id, date, votes): the date most rule families agree on, two at least; first seen wins ties."""
    votes = candidates_.groupBy("page_id", "date").agg(F.count("*").alias("votes"), F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("votes"), "pos"))
    return votes.withColumn("nth", nth).where("nth = 1 AND votes >= 2").select("page_id", "date", "votes")


def updated(weights: dict[str, float], bias: float, steps, rate: float) -> tuple[dict[str, float], float]:
    """Online logistic steps (features, label) in order: w += rate * error * x, error within 1."""
    import math

    w = dict(weights)
    for x, label in steps:
        miss = max(-1.0, min(1.0, label - 1 / (1 + math.exp(-(bias + sum(w.get(k, 0.0) * v for k, v in x.items()))))))
        for k, v in x.items():
            if v:
                w[k] = w.get(k, 0.0) + rate * miss * v
        bias += rate * miss
    return w, bias


#: How far one outcome moves a weight.
LEARNING_RATE = 0.05


def outcomes(picked: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, source, date, right) of picks whose page's true day is known: 1 within a day, else 0."""
    day = lambda c: F.expr(f"try_cast({c} AS date)")
    near = F.abs(F.datediff(day("date"), day("true_date"))) <= 1
    return picked.where("date <> ''").join(known.select("page_id", "true_date"), "page_id").select("page_id", "source", "date", F.when(F.coalesce(near, F.lit(False)), 1.0).otherwise(0.0).alias("right"))


def learned(ledger: DataFrame, weights: dict[str, float] | None = None, bias: float = CANDIDATE_BIAS, rate: float = LEARNING_RATE) -> DataFrame:
    """(model, feature, weight) after each model's ledger (model, at, id, features map, label) in order.

    The bias is feature ``bias``.  Order matters, so one model's ledger, which ``retention`` bounds,
    is one sequence; repeated ids count once.  A model without a ledger keeps its priors.
    """
    import pandas as pd

    start = dict(SOURCE_WEIGHTS if weights is None else weights)

    def run(pdf):
        rows = pdf.drop_duplicates("id").sort_values(["at", "id"])
        w, b = updated(start, bias, [(dict(f), y) for f, y in zip(rows["features"], rows["label"], strict=True)], rate)
        names = [*w, "bias"]
        return pd.DataFrame({"model": [pdf["model"].iloc[0]] * len(names), "feature": names, "weight": [*w.values(), b]})

    return ledger.groupBy("model").applyInPandas(run, "model string, feature string, weight double")


def inspected(weights: DataFrame) -> DataFrame:
    """(model, feature, weight, moved): a model's weights and how far they are from their priors."""
    prior = F.coalesce(*(F.when(F.col("feature") == k, F.lit(v)) for k, v in {**SOURCE_WEIGHTS, "bias": CANDIDATE_BIAS}.items()), F.lit(0.0))
    return weights.withColumn("moved", F.col("weight") - prior)
