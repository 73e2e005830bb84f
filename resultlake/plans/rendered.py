"""Rows that queries of single functions run on: literal cases, and rows rendered from the given tables.

Every row of a table gives one: its words, numbers and address in one of several forms that result
pages have (dates as sites write them, titles with site names, marked ads, blocked pages, redirects).
Literal cases come first, with ids below OFFSET.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Dialect
from ..sources import tables

OFFSET = 1000


class Rendered:
    """A literal fixture and a table's rows in its columns; each column is SQL, or makes it of a dialect."""

    def __init__(self, fixture, table: str, where: str = "true", **columns):
        self.fixture, self.table, self.where, self.columns = fixture, table, where, columns

    def df(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = tables.table(spark, folder, self.table).where(self.where).selectExpr(*self._columns(SPARK))
        return self.fixture.df(spark, folder).unionByName(rows)

    def _columns(self, d: Dialect) -> list[str]:
        kinds = dict(c.split() for c in self.fixture.columns.split(", "))
        shown = {"array<double>": "ARRAY<DOUBLE>" if d.spark else "DOUBLE[]"}
        return [f"CAST({e(d) if callable(e := self.columns[n]) else e} AS {shown.get(k, k.upper())}) AS {n}" for n, k in kinds.items()]

    @property
    def sql(self) -> str:
        return f"{self.fixture.sql} UNION ALL SELECT {', '.join(self._columns(DUCK))} FROM {self.table} WHERE {self.where}"


def word(k: int, text: str = "text") -> str:
    """The k-th word of a text."""
    return f"split_part(replace(coalesce({text}, ''), chr(10), ' '), ' ', {k})"


def forms(by: str, *of: str) -> str:
    """One of several expressions, in turn by a number."""
    return f"(CASE {by} % {len(of)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(of)) + " END)"


def base64(d: Dialect, e: str) -> str:
    return f"base64(CAST({e} AS BINARY))" if d.spark else f"base64(encode({e}))"


A, B, C, E = (word(k) for k in (1, 2, 3, 4))
N = "(doc_id % 27 + 1)"
M = "(doc_id % 12 + 1)"
title = lambda d: forms(
    "doc_id", f"{A} || ' ' || {B} || ' - 知乎'", f"{A} || ' 爬虫教程_CSDN博客'", f"'今日' || {B} || ' 2026年' || {M} || '月'", f"{A} || ', ' || {B} || ': the Guide | GitHub'", f"{C} || '公司_百度百科'", "substr(coalesce(text, ''), 1, 60)",
    f"'最新发布：' || {A} || ' 手机 the best phone'", f"{B} || '—发布 新 模型 - 官方网站'", f"'微信公众号 小程序 ' || {A} || '3 教程 2026'", f"{A} || '|' || {B} || '·' || {C} || '•' || {E}", f"'[视频] ' || {d.upper(A)} || ' （' || {B} || '）'", f"{A} || {A} || '、' || {B}",
)
DATE = forms(
    "doc_id", f"{N} || '小时前'", "'昨天 12:30'", "'前天'", f"{N} || ' 天前'", f"{N} || '周前'", f"{N} || '个月前'", f"{N} || '年前'", f"'2026年' || {M} || '月' || {N} || '日'", f"'2026-' || {M} || '-' || {N}", f"{M} || '月' || {N} || '日 ' || {A}", "'阅读量 ' || doc_id",
    f"'2026/0' || (doc_id % 7 + 1) || '/0' || (doc_id % 9 + 1)", "(2015 + doc_id % 11) || '-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 9)", f"{A} || ' ' || {B}", f"{N} || '分钟前'",
)


def all_of(named: dict) -> dict:
    """The fixtures of ``named`` with the rows of a table behind each."""
    page = "(page_id + 1000)"
    head = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    link = lambda d: forms("page_id", "url", f"'https://cn.bing.com/ck/a?a=b&u=a1' || replace({base64(d, 'url')}, '=', '')", "url || '&utm_source=1'", "replace(url, 'http', 'ftp')", "'https://news.site.example/2026/0' || (page_id % 9 + 1) || '/' || page_id || '.html'")
    body = "substr(regexp_extract(html, '<p>([^<]*)</p>', 1), 1, 120)"
    spec = {
        "TITLES": ("documents", "true", {"id": "doc_id + 1000", "s": title}),
        "DATED": ("documents", "true", {"id": "doc_id + 1000", "s": DATE}),
        "LINKS": ("pages", "true", {"id": page, "url": link}),
        "RESULTS": ("pages", "true", {
            "id": page, "title": lambda d: forms("page_id", head, f"'【广告】' || {head}", f"{head} || ' - 港口网'", f"'免费' || {head} || '下载'", d.upper(head), f"{head} || '!!'", f"substr({head}, 1, 3)"),
            "url": forms("page_id", "url", "'https://www.doubleclick.net/ads/' || page_id", "'https://x.example/redirect?url=' || url", "'https://t.cn/a' || page_id", "url || '?a=1&b=2&c=3&d=4&e=5&f=6'"),
            "text": forms("page_id", body, f"'广告位招商,从优。' || {body}", f"'立即下载,马上注册领取礼物!' || {body}", "''", f"substr({body}, 1, 8)", f"'本页无广告,' || {body}"), "is_ad": "page_id % 17 = 0",
        }),
        "ASKED": ("conversations", "role = 'user'", {"id": "conv_id * 100 + turn + 1000", "q": forms("(conv_id + turn)", "substr(text, 1, 40)", "substr(text, 1, 12) || '最新进展'", "'latest ' || substr(text, 1, 20)", "'历史' || substr(text, 1, 10) || '大事件'", "(1930 + conv_id % 90) || '年' || substr(text, 1, 10)", "'近 3 天 ' || substr(text, 1, 10)")}),
        "MARKUP": ("pages", "true", {"id": page, "html": forms("page_id", "html", "'<title>Just a moment...</title>' || html", "'<p>Too Many Requests</p>'", "'<title>404 页面不存在</title>' || substr(html, 1, 50)", f"'<div class=g-recaptcha></div>' || {body}", f"'<h1>Access Denied</h1>' || {head}", f"'<p>' || {head} || ' &amp; &lt;b&gt; &#39;x&#39; A%26B &copy; 中 文</p>'")}),
        "FETCHED": ("documents", "true", {"id": "doc_id + 1000", "markdown": forms("doc_id", "coalesce(text, '')", "substr(coalesce(text, ''), 1, 150)", "'正在加载…' || substr(coalesce(text, ''), 1, 220)", "'403 forbidden'", "substr(coalesce(text, ''), 1, 300) || '.'"), "is_list": "doc_id % 4 = 0", "n_list": "doc_id % 6", "html_bytes": "n_chars * 7 % 60000", "extra": forms("doc_id", "''", "'title'", "'请输入验证码'")}),
        "PROMO": ("documents", "text IS NOT NULL", {"id": "doc_id + 1000", "title": f"{A} || ' ' || {B}", "body": "text || chr(10) || repeat('立即咨询我们的顾问,免费试用名额有限。' || chr(10), CAST(doc_id % 13 AS INT))"}),
        "COSINES": ("embeddings", "true", {"id": "vec_id + 1000", "a": "embedding", "b": lambda d: "reverse(embedding)" if d.spark else "list_reverse(embedding)", "n": "vec_id % 1000"}),
        "PAIRS": ("documents", "text IS NOT NULL", {"id": "doc_id + 1000", "a": "substr(text, 1, 80)", "b": forms("doc_id", f"substr(text, 1, 80) || ' - ' || {A}", "substr(text, 10, 80)", f"{A} || ' ' || {B}", "substr(text, 30, 70)")}),
        "CLUSTERS": ("documents", "true", {"query_id": "floor(doc_id / 5) + 100", "cluster_id": "doc_id % 5", "label": A, "size": "doc_id % 7 + 1", "sem_score": "CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars * 37 % 100 / 100.0 END", "text_score": "n_chars * 53 % 100 / 100.0"}),
        "HITS": ("documents", "true", {"query_id": "floor(doc_id / 8) + 100", "query": forms("CAST(floor(doc_id / 8) AS BIGINT)", "'港口最新进展'", "'历史大事件'", "'latest ' || CAST(floor(doc_id / 8) AS BIGINT)"), "idx": "doc_id % 8", "date": f"CASE WHEN doc_id % 10 = 9 THEN NULL ELSE {DATE} END", "rel": "(n_chars * 37 % 200 - 100) / 100.0"}),
        "ANSWERS": ("events", "true", {"query_id": "floor(event_id / 4) + 100", "engine": "'e' || (event_id % 4)", "ord": "event_id % 4", "cjk": "floor(event_id / 4) % 2 = 0", "zh_only": "event_id % 4 IN (1, 2)", "ok": "event_type <> 'error'", "blocked": "event_type = 'error'", "polluted": "user_id % 7 = 0", "n": "user_id % 5"}),
        "FACTORS": ("events", "true", {"id": "event_id + 1000", "score": "floor(least(100, value)) / 100", "samples": "user_id % 12", "age": "event_id % 150", "avail": "floor(least(80, value)) / 100", "avail_n": "event_id % 6", "uses": "event_id % 9"}),
        "TIERS": ("events", "true", {"id": "event_id + 1000", "specific": "event_id % 11", "generic": "CAST(floor(value) AS BIGINT) % 9", "stream": "user_id % 4", "entries": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 21 END", "most": "10"}),
    }
    return {name: Rendered(named[name], table, where, **columns) for name, (table, where, columns) in spec.items() if name in named}


def day(d: Dialect, by: str = "page_id") -> str:
    """A day of the first months of 2026, as text."""
    return f"date_format(date_add(DATE'2026-01-01', CAST({by} % 200 AS INT)), 'yyyy-MM-dd')" if d.spark else f"strftime(DATE '2026-01-01' + CAST({by} % 200 AS INTEGER), '%Y-%m-%d')"


#: What states the day of a rendered page, in turn by its number; the last states none.
STATED_BY = ("meta-article", "jsonld", "list-time", "url", "body-ctx", "js-var", "url", "none")


def dated_pages(d: Dialect) -> dict[str, str]:
    """Columns (page_id, url, html) of stored pages that state their day, each in one way or two that agree."""
    when = day(d)
    plain = "'<article><p>' || regexp_extract(html, '<p>([^<]*)</p>', 1) || '</p></article>'"
    path = f"'https://news.site.example/' || substr({when}, 1, 4) || '/' || substr({when}, 6, 2) || substr({when}, 9, 2) || '/c' || page_id || '.html'"
    other = "'https://site.example/c' || (page_id % 97) || 'x'"
    html = forms(
        "page_id", f"'<meta property=\"article:published_time\" content=\"' || {when} || 'T08:00:00Z\">' || {plain}", f"'<script type=\"application/ld+json\">{{\"datePublished\":\"' || {when} || '\"}}</script>' || html", f"'<time datetime=\"' || {when} || '\">x</time>' || html", "html",
        f"'<p>发布时间：' || {when} || '</p>' || html", f"'<script>var publishTime=\"' || {when} || '\"</script>' || html", f"'<meta name=\"date\" content=\"' || {when} || '\">' || {plain}", "html",
    )
    return {"page_id": "page_id", "url": forms("page_id", other, other, other, path, other, other, path, other), "html": html}


def stated(d: Dialect, by: str = "page_id") -> tuple[str, str]:
    """(date, source) that picking must find on ``dated_pages``."""
    days = [f"'{''}'" if s == "none" else day(d, by) for s in STATED_BY]
    return forms(by, *days), forms(by, *(f"'{s}'" for s in STATED_BY))
