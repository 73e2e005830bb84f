"""Named queries over the driver tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls, vectors
from ..functions.dialect import DUCK, SPARK
from ..operators import cluster, embed, evidence, filters, grade, links, merge, neighbours, pages, pubdate, reputation, spans
from ..sources import serp, tables
from ..staging import staged
from ..streaming import state
from . import rendered, search

AS_OF = "2026-08-10"
EVENTS_AS_OF = "2024-02-01"
STOP = ["今日", "最新", "发布", "中国", "新闻", "视频"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


class Fixture:
    """Literal rows, as a DataFrame and as SQL."""

    def __init__(self, columns: str, rows: list[tuple]):
        self.columns, self.rows = columns, rows

    def df(self, spark: SparkSession, _: str) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def sql(self) -> str:
        show = lambda v: "NULL" if v is None else DUCK.lit(v) if isinstance(v, str) else str(v)
        names, kinds = zip(*(c.split() for c in self.columns.split(", ")), strict=True)
        kinds = [{"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "array<double>": "DOUBLE[]"}[k] for k in kinds]
        values = ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in self.rows)
        return f"SELECT {', '.join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in zip(names, kinds, strict=True))} FROM (VALUES {values}) AS t({', '.join(f'"{n}"' for n in names)})"


class Table:
    def __init__(self, name: str, *columns: str, where: str = "true"):
        self.name, self.columns, self.where = name, columns, where

    def df(self, spark, folder):
        return tables.table(spark, folder, self.name).where(self.where).selectExpr(*self.columns)

    @property
    def sql(self):
        return f"SELECT {', '.join(self.columns)} FROM {self.name} WHERE {self.where}"


def scalars(name: str, base, keys_: list[str], /, **built):
    """A query of scalar functions over a relation; each of ``built`` makes one column."""

    def run(spark, folder):
        return base.df(spark, folder).select(*keys_, *(F.expr(f(SPARK)).alias(k) for k, f in built.items()))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(keys_ + [f'{f(DUCK)} AS {k}' for k, f in built.items()])} FROM ({base.sql})"


PAGES = Table("pages", "page_id", "url", "html")
DOCS = Table("documents", "doc_id", "text", "substr(text, 1, 60) AS title")
TURNS = Table("conversations", "conv_id", "turn", "text", where="role = 'user'")
TITLES = Fixture("id bigint, s string", [(1, "计算机专业学习路线 - 知乎"), (2, "Python 爬虫教程_CSDN博客"), (3, "今日黄历 2026年8月"), (4, "Welcome, Cot: the Guide | GitHub"), (5, "潮汐表_百度百科"), (6, ""), (7, "最新发布：苹果 手机 the best phone"), (8, "OpenAI—发布 新 模型 - 官方网站"), (9, "微信公众号 小程序 python3 教程 2026"), (10, "A|B·C•D")])
DATED = Fixture("id bigint, s string", [(1, "3小时前"), (2, "昨天 12:30"), (3, "前天"), (4, "5 天前"), (5, "2周前"), (6, "3个月前"), (7, "1年前"), (8, "2026年8月5日"), (9, "2026-7-1"), (10, "8月1日 新闻"), (11, "阅读量 1000"), (12, ""), (13, "2026/08/07"), (14, "2019-05-01"), (15, "2026年13月1日"), (16, "上周"), (17, "2027-01-01"), (18, "20261105")])
LINKS = Fixture("id bigint, url string", [(1, "https://www.cnblogs.com/harbour/p/1"), (2, "https://zhuanlan.zhihu.com/p/1"), (3, "https://news.harbour.com.cn/a"), (4, "not a url"), (5, "https://e.so.com/we?q=1"), (6, "https://news.example.com/2026/08/story"), (7, "https://github.com/login"), (8, "https://www.zhihu.com/question/123"), (9, "https://m.a.com/x/?utm_source=1&b=2&ref=3#top"), (10, "http://www.people.com.cn/n1/2026/0801/c1024-1.html"), (11, "https://x.com/2026/8/7/story.html"), (12, "https://cn.bing.com/ck/a?p=q&u=a1aHR0cHM6Ly9oYXJib3VyLmV4YW1wbGUvdGlkZS83"), (13, "http://localhost/x"), (14, "http://10.0.0.1/"), (15, "ftp://a.com/"), (16, "http://u:p@a.com/"), (17, "http://8.8.8.8/dns"), (18, "http://192.168.1.1/"), (19, "http://3232235777/"), (20, "http://[::1]/"), (21, "http://[2606:4700::1]/"), (22, "https://a.com/wz/1"), (23, "http://172.20.1.1:8080/a"), (24, "https://blog.dev.example.co/a-b/c.d/12")])
RESULTS = Fixture("id bigint, title string, url string, text string, is_ad boolean", [
    (1, "【广告】夏日家电促销", "https://a.com/x/1.html", "描述" * 20, False), (2, "平常的一条标题", "https://clk.doubleclick.net/tide/77", "摘要内容很长很长很长很长很长很长", False), (3, "转到别处的标题", "https://x.com/redirect?url=https://evil.com", "摘要内容很长很长很长很长很长很长", False),
    (4, "一则平实的标题", "https://b.com/a/1.html", "本页无广告,只有文章,请慢慢读完", False), (5, "一则平实的标题", "https://b.com/a/2.html", "广告位招商,从优,请与编辑部联系", False), (6, "今日动态 - 港口网", "https://www.harbour.example/newsf/", "", False),
    (7, "免费字体下载中心", "https://v.com/a/b/c", "立即下载字体包,马上注册领取礼物!", False), (8, "HARBOUR NEWS TONIGHT", "https://c.com/a/b", "short", False), (9, "港口!!惊人", "https://t.cn/abc", "一段足够长的摘要文字用来避免短摘要标志", False), (10, "短", "https://d.com/p/x?a=1&b=2&c=3&d=4&e=5&f=6", "一段足够长的摘要文字用来避免短摘要标志", False),
    (11, "Sponsored result", "https://e.com/1", "An ordinary description of the page in words.", True), (12, "Long address", "https://f.com/" + "a" * 250, "An ordinary description of the page in words.", False),
])
ASKED = Fixture("id bigint, q string", [(i, q) for i, q in enumerate(["港口扩建大事件", "突发暴雨", "环保条例最新进展", "本周展览", "1935年大事件", "建校百年大事记", "历史大事件", "纪念建市40周年", "那年往事", "近期演出", "latest harbour news", "how to bake bread", "苹果 发布会", "近 3 天 天气", ""])])
MARKUP = Fixture("id bigint, html string", [(1, "<title>Just a moment...</title>"), (2, "<p>Too Many Requests</p>"), (3, "<title>404 - no such page</title>"), (4, "<title>How to handle 404 errors in your app and other useful lessons for everyone</title><p>fine</p>"), (5, '{"error":{"code":40362,"message":"您当前请求存在异常"}}'), (6, "<div class=g-recaptcha></div>"), (7, "<h1>Access Denied</h1>"), (8, "<p>enable JavaScript to go on</p>"), (9, "<p>plain &amp; simple &lt;b&gt; &#39;x&#39; A%26B &copy; 中 文</p>"), (10, "<title>404 页面不存在</title>"), (11, "<body>404 请求的页面不存在</body>")])
FETCHED = Fixture("id bigint, markdown string, is_list boolean, n_list bigint, html_bytes bigint, extra string", [(1, "word " * 60 + "W", False, 0, 39964, ""), (2, "word " * 60 + "end.", False, 0, 39964, ""), (3, "正在加载…" + "x" * 220, False, 0, 0, ""), (4, "item " * 20, True, 3, 0, ""), (5, "403 forbidden", False, 0, 0, ""), (6, "", False, 0, 0, "title"), (7, "short", False, 0, 0, "请输入验证码")])
PROMO = Fixture("id bigint, title string, body string", [(1, "好产品", "立即咨询我们的顾问,免费试用名额有限。\n" * 12), (2, "无关标题", "".join(f"这是第{i:02}句整齐划一的文字内容。" for i in range(40))), (3, "python 教程", "python 教程 " + "".join(f"第{i}课讲解不同长度的主题" + "内容" * (i % 7) + "。" for i in range(60))), (4, "短", "短文"), (5, "alpha beta", "gamma delta " * 100)])
COSINES = Fixture("id bigint, a array<double>, b array<double>, n bigint", [(1, [1.0, 0.0], [0.8, 0.6], 400), (2, [1.0, 0.0], [0.0, 1.0], 400), (3, [1.0, 2.0], [0.0, 0.0], 400), (4, [3.0, 4.0], [4.0, 3.0], 100), (5, [1.0, 0.0], [0.3, 0.9], 900)])
PAIRS = Fixture("id bigint, a string, b string", [(1, "人工智能大模型最新进展报告全文发布", "人工智能大模型最新进展报告全文发布 - 新浪"), (2, "完全不同的标题内容在这里", "另外一个毫无关系的话题讨论"), (3, "short", "short"), (4, "The quick brown fox jumps over", "A quick brown fox jumps over it"), (5, "abcdefghijklmnopqrstuvwxyz0123456789", "zzzz abcdefghijklmnopqrstuvwxyz zzzz")])
CLUSTERS = Fixture("query_id bigint, cluster_id bigint, label string, size bigint, sem_score double, text_score double", [(1, 0, "甲", 3, 0.59, 0.7), (1, 1, "乙", 2, 0.36, 0.6), (1, 2, "丙", 2, 0.32, 0.1), (1, 3, "丁", 1, 0.20, 0.6), (2, 0, "戊", 2, 0.9, 0.5), (2, 1, "己", 1, 0.5, 0.5), (2, 2, "庚", 1, None, 0.5), (3, 0, "辛", 1, None, 0.2)])
HITS = Fixture("query_id bigint, query string, idx bigint, date string, rel double", [(1, "港口扩建大事件", 0, "2026-08-01", 0.2), (1, "港口扩建大事件", 1, "2019-05-01", 0.9), (1, "港口扩建大事件", 2, None, 0.5), (1, "港口扩建大事件", 3, "2020-01-01", -0.3), (2, "历史大事件", 0, "2019-05-01", 0.1), (2, "历史大事件", 1, "2026-08-07", 0.4), (3, "latest news", 0, "3小时前", 0.0), (3, "latest news", 1, "3个月前", 0.3), (3, "latest news", 2, "5天前", 0.3)])
ENGINES = Fixture("engine string, ord bigint, zh_only boolean, en_only boolean, page_limit bigint", [("bing", 0, False, False, None), ("baidu", 1, True, False, 20), ("hn", 2, False, True, 5), ("so360", 3, True, False, None), ("wikipedia", 4, False, True, 8)])
ANSWERS = Fixture("query_id bigint, engine string, ord bigint, cjk boolean, zh_only boolean, ok boolean, blocked boolean, polluted boolean, n bigint", [(1, "bing", 0, False, False, False, True, False, 0), (1, "baidu", 1, False, True, True, False, False, 4), (1, "so360", 2, False, True, True, False, False, 0), (2, "bing", 0, False, False, True, False, True, 3), (2, "baidu", 1, False, True, True, False, False, 5), (3, "bing", 0, True, False, False, True, False, 0), (3, "baidu", 1, True, True, True, False, False, 9)])
TIERS = Fixture("id bigint, specific bigint, generic bigint, stream bigint, entries bigint, most bigint", [(1, 10, 0, 0, 10, 10), (2, 3, 9, 0, None, 10), (3, 5, 4, 0, 20, 20), (4, 1, 0, 0, 10, 10), (5, 0, 0, 7, None, 10), (6, 0, 0, 0, None, 10), (7, 2, 2, 0, 4, 10)])

# queries and their SQL run on the literal cases and on rows rendered from the tables
_all = rendered.all_of({n: globals()[n] for n in ("TITLES", "DATED", "LINKS", "RESULTS", "ASKED", "MARKUP", "FETCHED", "PROMO", "COSINES", "PAIRS", "CLUSTERS", "HITS", "TIERS", "ANSWERS")})
TITLES, DATED, LINKS, RESULTS, ASKED, MARKUP, FETCHED = (_all[n] for n in ("TITLES", "DATED", "LINKS", "RESULTS", "ASKED", "MARKUP", "FETCHED"))
PROMO, COSINES, PAIRS, CLUSTERS, HITS, TIERS, ANSWERS = (_all[n] for n in ("PROMO", "COSINES", "PAIRS", "CLUSTERS", "HITS", "TIERS", "ANSWERS"))

joined = lambda f, *a: lambda d: d.join(f(d, *a), "|")
scalars("text_strip", PAGES, ["page_id"], stripped=lambda d: text.strip_tags(d, "html"))
scalars("text_clean", MARKUP, ["id"], cleaned=lambda d: text.clean(d, "html"), decoded=lambda d: text.decode_entities(d, "html"))
scalars("text_control", DOCS, ["doc_id"], plain=lambda d: text.strip_control(d, "text"))
scalars("title_normalize", TITLES, ["id"], normal=lambda d: text.normalize_title(d, "s"))
scalars("label_clean", TITLES, ["id"], cleaned=lambda d: text.label_title(d, "s"))
scalars("cjk_grams", TITLES, ["id"], two=joined(text.grams, "s", 2), three=joined(text.grams, "s", 3), four=joined(text.grams, "s", 4))
scalars("en_words", TURNS, ["conv_id", "turn"], plain=joined(text.words_plain, "text"), mixed=joined(text.words_mixed, "text"))
scalars("title_tokens", TITLES, ["id"], tokens=joined(text.title_tokens, "s"), without_stops=joined(text.title_tokens, "s", STOP))
scalars("query_tokens", TITLES, ["id"], tokens=joined(text.query_tokens, "s"))
scalars("body_tokens", DOCS, ["doc_id"], tokens=joined(text.body_tokens, "text"))
scalars("sentence_stats", DOCS, ["doc_id"], n=lambda d: text.sentence_count(d, "text"), cv=lambda d: f"round({text.sentence_cv(d, 'text')}, 6)")
scalars("first_paragraph", DOCS, ["doc_id"], first=lambda d: text.first_paragraph(d, "text"))
scalars("line_repetition", DOCS, ["doc_id"], repeated=lambda d: f"round({text.repetition(d, 'text')}, 6)")
scalars("title_coverage", DOCS, ["doc_id"], coverage=lambda d: f"round({text.title_coverage(d, 'title', 'text')}, 6)")
scalars("near_dup_text", PAIRS, ["id"], title=lambda d: text.near_title(d, "a", "b"), description=lambda d: text.near_description(d, "a", "b"), likeness=lambda d: f"round({vectors.jaccard(d, text.words_mixed(d, 'a'), text.words_mixed(d, 'b'))}, 6)")
for _name, _base, _key in (("", LINKS, "id"), ("_pages", PAGES, "page_id")):
    scalars("url_normalize" + _name, _base, [_key], url_key=lambda d: urls.dedup_key(d, "url"))
    scalars("registrable_host" + _name, _base, [_key], host=lambda d: urls.registrable(d, "url"), stem=lambda d: urls.stem(d, "url"))
    scalars("rep_keys" + _name, _base, [_key], keys=joined(urls.rep_keys, "url"))
    scalars("url_tokens" + _name, _base, [_key], tokens=joined(urls.tokens, "url"))
    scalars("url_safety" + _name, _base, [_key], reason=lambda d: urls.unsafe_reason(d, "url"))
    scalars("url_date" + _name, _base, [_key], date=lambda d: dates.url_date(d, "url"), score=lambda d: urls.article_score(d, "url"), functional=lambda d: urls.functional(d, "url"))
scalars("redirect_decode", LINKS, ["id"], target=lambda d: urls.redirect_target(d, "url"))
scalars("page_cache_key", PAGES, ["page_id"], key=lambda d: urls.cache_key(d, "url"))
scalars("serp_date", DATED, ["id"], short=lambda d: dates.serp_date(d, "s", AS_OF), absolute=lambda d: dates.absolute(d, "s"))
scalars("date_ago", DATED, ["id"], days=lambda d: dates.days_ago(d, "s", AS_OF))
scalars("abs_date", DATED, ["id"], date=lambda d: dates.absolute_of(d, "s", AS_OF))
scalars("detect_flags", RESULTS, ["id"], flags=joined(filters.flags, "title", "url", "text", "is_ad"))
scalars("ad_flags", RESULTS, ["id"], **{k.replace(":", "_").replace("-", "_"): (lambda d, k=k: filters.ad_flags(d, "title", "url", "text", "is_ad")[k]) for k in ("ad:serp-marker", "ad:title-marker", "ad:desc-marker", "ad:domain", "ad:redirect-url")})
scalars("index_page", RESULTS, ["id"], index_page=lambda d: filters.index_page(d, "url", "title", "text"))
scalars("quality_score", RESULTS, ["id"], quality=lambda d: f"round({filters.quality(d, filters.flags(d, 'title', 'url', 'text', 'is_ad'))}, 6)")
scalars("time_intent", ASKED, ["id"], asks=lambda d: filters.time_intent(d, "q"), cjk=lambda d: filters.is_cjk(d, "q"))
scalars("antibot_type", MARKUP, ["id"], kind=lambda d: pages.antibot(d, "html"))
scalars("not_found", MARKUP, ["id"], missing=lambda d: pages.not_found(d, "html"))
scalars("antibot_pages", PAGES, ["page_id"], kind=lambda d: pages.antibot(d, "html"), missing=lambda d: pages.not_found(d, "html"))
scalars("fetch_class", FETCHED, ["id"], kind=lambda d: pages.fetch_class(d, "markdown", "is_list", "n_list", "html_bytes", "extra"))
scalars("page_title_meta", PAGES, ["page_id"], title=lambda d: pages.title(d, "html"), description=lambda d: pages.description(d, "html"))
scalars("body_regex", PAGES, ["page_id"], body=lambda d: pages.body(d, "html"))
scalars("list_decision", PAGES, ["page_id"], is_list=lambda d: pages.is_list(d, f"length({pages.body(d, 'html')})", d.size(d.every("html", "<a ")), d.size(d.every("html", "<a ")) + " * 10"))
scalars("semantic_evidence", COSINES, ["id"], dot=lambda d: f"round({vectors.dot(d, 'a', 'b')}, 6)", unit=lambda d: d.join(d.each(vectors.unit(d, "a"), "q", "CAST(CAST(round(q * 1000) AS BIGINT) AS STRING)" if d.spark else "CAST(CAST(round(q * 1000) AS BIGINT) AS VARCHAR)"), "|"), **{k: (lambda d, k=k: f"round({evidence.semantic(d, 'a', 'b', 'n')[k]}, 6)") for k in ("sim", "label", "confidence")})


def _structural_sql(base: str, key: str) -> str:
    measured = ", ".join(f"{e} AS {k}" for k, e in evidence.measures(DUCK, "title", "body").items())
    return f"SELECT {key}, promo, round(repeated, 6) AS repeated, round(coverage, 6) AS coverage, reason, {evidence.verdict(DUCK, 0)} AS label, {evidence.verdict(DUCK, 1)} AS confidence FROM (SELECT *, {evidence.reason(DUCK)} AS reason FROM (SELECT {key}, {measured} FROM ({base})))"


def _structural(df: DataFrame, key: str) -> DataFrame:
    return evidence.structural(df).select(key, "promo", F.round("repeated", 6).alias("repeated"), F.round("coverage", 6).alias("coverage"), "reason", "label", "confidence")


CONTENTS_SQL = "SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 60) AS title, text AS body FROM documents"


@query("content_evidence", _structural_sql(CONTENTS_SQL, "doc_id"))
def _(spark, folder):
    return _structural(tables.contents(tables.table(spark, folder, "documents")), "doc_id")


@query("content_evidence_cases", _structural_sql(PROMO.sql, "id"))
def _(spark, folder):
    return _structural(PROMO.df(spark, folder), "id")


# --- merging ---------------------------------------------------------------------------------

_P = DUCK.ext("html", r"(?is)<p[^>]*>(.*?)</p>", 1)
LISTS_SQL = f"""
WITH base AS (SELECT page_id, page_id // 1000 * 10 + page_id % 10 AS query_id, page_id % 4 AS src_order, url, {pages.title(DUCK, "html")} AS title, substr({text.strip_tags(DUCK, _P)}, 1, 160) AS text FROM pages),
again AS (SELECT page_id, query_id, 9 AS src_order, regexp_replace(url, '^https?://', 'https://www.') || CASE WHEN url LIKE '%?%' THEN '&' WHEN url LIKE '%#%' THEN '' ELSE '?' END || CASE WHEN url LIKE '%#%' THEN '' ELSE 'utm_source=x' END AS url, title, text FROM base WHERE page_id % 3 = 0),
lists AS (SELECT *, 'e' || src_order AS src, row_number() OVER (PARTITION BY query_id, src_order ORDER BY page_id) AS pos FROM (SELECT * FROM base UNION ALL SELECT * FROM again)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY pos) AS source_rank, count(*) OVER (PARTITION BY query_id, src) AS source_count, {urls.dedup_key(DUCK, "url")} AS url_key FROM lists),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_order, pos) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url_key ORDER BY src_order, pos) AS nth FROM ranked) WHERE nth = 1),
noted AS (SELECT *, {filters.flags(DUCK, "title", "url", "text", "false")} AS flags FROM merged)
"""


def _lists(spark, folder, asked=False):
    lists = tables.result_lists(tables.table(spark, folder, "pages"))
    return tables.asked(lists, tables.title_queries(lists)) if asked else lists


@query("source_rank", LISTS_SQL + "SELECT query_id, src, page_id, source_rank, source_count FROM ranked")
def _(spark, folder):
    return merge.ranked(_lists(spark, folder)).select("query_id", "src", "page_id", "source_rank", "source_count")


@query("merge_dedupe", LISTS_SQL + "SELECT query_id, idx, src, page_id, url_key, title FROM merged")
def _(spark, folder):
    return merge.merged(_lists(spark, folder)).select("query_id", "idx", "src", "page_id", "url_key", "title")


@query("merge_limit", LISTS_SQL + "SELECT query_id, idx, page_id FROM merged WHERE idx < 10")
def _(spark, folder):
    return merge.merged(_lists(spark, folder), 10).select("query_id", "idx", "page_id")


@query("engine_counts", LISTS_SQL + "SELECT query_id, src, count(*) AS fetched, coalesce(max(k), 0) AS kept FROM ranked LEFT JOIN (SELECT query_id, src, count(*) AS k FROM merged GROUP BY ALL) USING (query_id, src) GROUP BY query_id, src")
def _(spark, folder):
    return merge.counts(_lists(spark, folder))


@query("engine_note", LISTS_SQL + ", c AS (SELECT query_id, src, count(*) AS fetched, coalesce(max(k), 0) AS kept FROM ranked LEFT JOIN (SELECT query_id, src, count(*) AS k FROM merged GROUP BY ALL) USING (query_id, src) GROUP BY query_id, src) SELECT query_id, string_agg(src || '×' || kept || '(' || fetched || ')', ' + ' ORDER BY src) AS note FROM c GROUP BY query_id")
def _(spark, folder):
    return merge.note(merge.counts(_lists(spark, folder)))


@query("engine_targets", f"SELECT engine, least(coalesce(page_limit, 10), greatest(CAST(ceil(99 / (SELECT count(*) FROM ({ENGINES.sql})) ) AS BIGINT), least(10, 99))) AS target FROM ({ENGINES.sql})")
def _(spark, folder):
    return merge.targets(ENGINES.df(spark, folder), 99)


@query("lang_gate", f"SELECT a.id AS query_id, e.engine FROM ({ASKED.sql}) a, ({ENGINES.sql}) e WHERE e.ord = 0 OR (regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT en_only) OR (NOT regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT zh_only)")
def _(spark, folder):
    return merge.language_gate(ASKED.df(spark, folder).selectExpr("id AS query_id", "q AS query"), ENGINES.df(spark, folder))


@query("fallback_union", f"SELECT query_id, engine FROM (SELECT *, max(CASE WHEN (NOT zh_only OR cjk) AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_ok FROM ({ANSWERS.sql})) WHERE ok AND ((NOT zh_only OR cjk) OR (any_ok = 0 AND n > 0))")
def _(spark, folder):
    return merge.fallback_union(ANSWERS.df(spark, folder))


@query("fallback_chain", f"SELECT query_id, arg_min(engine, ord) AS engine FROM ({ANSWERS.sql}) WHERE NOT blocked AND NOT polluted AND n > 0 GROUP BY query_id")
def _(spark, folder):
    return merge.fallback_chain(ANSWERS.df(spark, folder))


@query("lang_pollution", f"SELECT id % 3 AS query_id, NOT regexp_matches(max(q), '[\\x{{4e00}}-\\x{{9fff}}]') AND avg(CASE WHEN regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 1.0 ELSE 0.0 END) >= 0.5 AS polluted FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'plain query' WHEN 1 THEN '中文' ELSE 'other' END AS q FROM ({TITLES.sql})) GROUP BY id % 3")
def _(spark, folder):
    rows = TITLES.df(spark, folder).selectExpr("id % 3 AS query_id", "CASE id % 3 WHEN 0 THEN 'plain query' WHEN 1 THEN '中文' ELSE 'other' END AS query", "s AS title")
    return merge.language_pollution(rows)


# --- filters ---------------------------------------------------------------------------------


@query("filter_split", LISTS_SQL + f"SELECT query_id, idx, array_to_string(flags, '|') AS flags, round({filters.quality(DUCK, 'flags')}, 6) AS quality, CASE WHEN len(list_filter(flags, lambda f: f LIKE 'ad:%')) > 0 THEN 'ad' WHEN len(flags) > 0 THEN 'flagged' ELSE 'clean' END AS part FROM noted")
def _(spark, folder):
    rows = filters.split(filters.annotate(merge.merged(_lists(spark, folder))))
    return rows.select("query_id", "idx", F.array_join("flags", "|").alias("flags"), F.round("quality", 6).alias("quality"), "part")


@query("recency_order", f"WITH h AS (SELECT *, CASE WHEN {filters.time_intent(DUCK, 'query')} AND {dates.days_ago(DUCK, 'date', AS_OF)} > 60 THEN {dates.days_ago(DUCK, 'date', AS_OF)} END AS stale_days FROM ({HITS.sql})) SELECT query_id, idx, stale_days, row_number() OVER (PARTITION BY query_id ORDER BY stale_days IS NOT NULL, coalesce(stale_days, 0), idx) AS place FROM h")
def _(spark, folder):
    return filters.recency(HITS.df(spark, folder), AS_OF).select("query_id", "idx", "stale_days", "place")


@query("since_filter", f"SELECT query_id, idx, date FROM ({HITS.sql}) WHERE coalesce({dates.days_ago(DUCK, 'date', AS_OF)} <= 7, true)")
def _(spark, folder):
    return filters.since(HITS.df(spark, folder), "1w", AS_OF).select("query_id", "idx", "date")


# --- clusters --------------------------------------------------------------------------------

TOKENS_SQL = LISTS_SQL + f", tokens AS (SELECT query_id, idx, unnest({text.title_tokens(DUCK, 'title')}) AS token FROM merged), df AS (SELECT query_id, token, count(*) AS df FROM tokens GROUP BY ALL HAVING count(*) >= 2)"


@query("doc_frequency", TOKENS_SQL + " SELECT query_id, token, df FROM df")
def _(spark, folder):
    return cluster.document_frequency(cluster.tokens(merge.merged(_lists(spark, folder))))


@query("top_phrases", TOKENS_SQL + " SELECT query_id, substr(token, 3) AS phrase, df, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df DESC, token) AS nth FROM df) WHERE nth <= 20")
def _(spark, folder):
    return cluster.top_phrases(cluster.document_frequency(cluster.tokens(merge.merged(_lists(spark, folder)))))


def _by_token(spark, folder):
    """Rows of a result list and clusters of all that share a frequent token: a relational stand-in."""
    rows = merge.merged(_lists(spark, folder, True)).withColumn("quality", F.lit(1.0)).withColumn("rel", F.lit(None).cast("double"))
    t = cluster.tokens(rows)
    often = cluster.top_phrases(cluster.document_frequency(t), 5).select("query_id", "phrase", F.col("nth").alias("cluster_id"))
    return rows, t.withColumn("phrase", F.expr("substr(token, 3)")).join(often, ["query_id", "phrase"]).select("query_id", "cluster_id", "idx").distinct()


MEMBERS_SQL = TOKENS_SQL + ", often AS (SELECT query_id, substr(token, 3) AS phrase, nth AS cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df DESC, token) AS nth FROM df) WHERE nth <= 5), members AS (SELECT DISTINCT query_id, cluster_id, idx FROM (SELECT query_id, idx, substr(token, 3) AS phrase FROM tokens) JOIN often USING (query_id, phrase)), scores AS (SELECT query_id, cluster_id, count(*) AS size, avg(CASE WHEN source_count > 1 THEN 1 - (source_rank - 1) / (source_count - 1) ELSE 1.0 END) AS rank_score FROM members JOIN merged USING (query_id, idx) GROUP BY ALL)"


@query("cluster_score", MEMBERS_SQL + " SELECT query_id, cluster_id, size, round(rank_score, 6) AS rank_score, round(0.3 * rank_score, 6) AS score, 0.3 * rank_score < 0.3 - 1e-9 AS low_relevance FROM scores")
def _(spark, folder):
    rows, members = _by_token(spark, folder)
    s = cluster.scored(members, rows)
    return s.select("query_id", F.col("cluster_id"), "size", F.round("rank_score", 6).alias("rank_score"), F.round("score", 6).alias("score"), (F.col("score") < 0.3 - 1e-9).alias("low_relevance"))


@query("cluster_assign", MEMBERS_SQL + " SELECT query_id, cluster_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, idx ORDER BY round(rank_score, 9) DESC, size DESC, cluster_id) AS nth FROM members JOIN scores USING (query_id, cluster_id)) WHERE nth = 1")
def _(spark, folder):
    rows, members = _by_token(spark, folder)
    scores = cluster.scored(members, rows)
    return cluster.assigned(members, scores.withColumn("score", F.round("rank_score", 9)))


@query("uncovered", MEMBERS_SQL + " SELECT query_id, idx, title FROM merged ANTI JOIN members USING (query_id, idx)")
def _(spark, folder):
    rows, members = _by_token(spark, folder)
    return cluster.uncovered(rows, members).select("query_id", "idx", "title")


@query("cluster_phrase")
def _(spark, folder):
    return cluster.by_phrase(merge.merged(_lists(spark, folder)))


@query("cluster_labels")
def _(spark, folder):
    rows = merge.merged(_lists(spark, folder))
    return cluster.labels(cluster.by_phrase(rows), rows)


def _vectors(spark, folder):
    v = tables.table(spark, folder, "embeddings")
    return v.select((F.col("label") % 10).cast("bigint").alias("query_id"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), F.array(F.concat(F.lit("e:"), "label")).alias("tokens"))


@query("cluster_semantic")
def _(spark, folder):
    return cluster.by_vector(_vectors(spark, folder), sim=0.25, buckets=False)


@query("singleton_buckets")
def _(spark, folder):
    # lists of 150 results at most, as a query's own limit has it
    return cluster.by_vector(_vectors(spark, folder).withColumn("query_id", F.expr("floor(idx / 150) * 10 + query_id")), sim=0.3)


@query("zh_dedupe")
def _(spark, folder):
    rows = merge.merged(_lists(spark, folder)).withColumn("stem", F.expr(urls.stem(SPARK, "url")))
    return cluster.farm_dedup(rows)


@query("cosine_to_query", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS sim FROM embeddings")
def _(spark, folder):
    v = tables.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("vec_id = 0").select(F.col("v").alias("q"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(F.expr(vectors.dot(SPARK, "v", "q")), 5).alias("sim"))


@query("semantic_rerank", f"SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0, rel) DESC, idx) AS place FROM ({HITS.sql})")
def _(spark, folder):
    return grade.rerank(HITS.df(spark, folder)).select("query_id", "idx", "place")


# --- spans of titles -------------------------------------------------------------------------

_SEGMENTS = f"list_filter(list_transform(string_split_regex(title, {DUCK.lit(f'[{spans.SEPARATORS}]+')}), lambda s: regexp_replace(s, {DUCK.lit(spans.EDGE)}, '', 'g')), lambda s: s <> '')"
SPANS_SQL = f"""WITH t0 AS (SELECT source AS "group", substr(string_split(text, chr(10))[1], 1, 60) AS title FROM documents),
t AS (SELECT "group", title, count(*) AS n FROM t0 WHERE title <> '' GROUP BY ALL),
subs AS (SELECT DISTINCT "group", title, substr(title, i, k) AS s FROM (SELECT *, unnest(range(1, length(title) - i + 2)) AS k FROM (SELECT *, unnest(range(1, length(title) + 1)) AS i FROM t))),
common AS (SELECT "group", s FROM subs JOIN t USING ("group", title) GROUP BY ALL HAVING sum(n) > 1),
runs AS (SELECT "group", title, arg_max(s, (length(s), -instr(title, s))) AS shared FROM subs JOIN common USING ("group", s) GROUP BY ALL),
segments AS (SELECT "group", title, s, row_number() OVER () AS r, pos FROM (SELECT "group", title, unnest({_SEGMENTS}) AS s, generate_subscripts({_SEGMENTS}, 1) AS pos FROM t)),
best AS (SELECT "group", title, arg_min(s, (CASE WHEN length(s) >= 2 AND c.s2 IS NULL THEN 0 ELSE 1 END, -length(s), pos)) AS own FROM segments LEFT JOIN (SELECT "group" AS g2, s AS s2 FROM common) c ON c.g2 = "group" AND c.s2 = s GROUP BY ALL)
SELECT "group", title, n, coalesce(shared, '') AS shared, CASE WHEN (SELECT sum(n) FROM t u WHERE u."group" = t."group") = 1 OR length(title) < 2 OR shared = title OR NOT regexp_matches(title, '[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]') THEN '' ELSE substr(coalesce(own, title), 1, 14) END AS own
FROM t LEFT JOIN runs USING ("group", title) LEFT JOIN best USING ("group", title)"""


@query("title_spans", SPANS_SQL)
def _(spark, folder):
    """Of every first line the span that another line of its source has, and the segment it has alone."""
    docs = tables.table(spark, folder, "documents")
    return spans.spans(docs.select(F.col("source").alias("group"), F.expr("substr(split(text, '\\n')[0], 1, 60)").alias("title")))


# --- vector neighbours -----------------------------------------------------------------------

_UNIT = "SELECT {id} AS id, list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v}))) AS v FROM ({rows})"
REPRINT_SQL = f"""WITH docs AS (SELECT doc_id AS id, substr(string_split(text, chr(10))[1], 1, 60) AS title, text FROM documents),
v AS MATERIALIZED ({_UNIT.format(id="id", v="v", rows=embed.projected_sql("docs", "id", "text"))}),
p AS (SELECT a.id AS qid, b.id AS id, list_inner_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id WHERE list_inner_product(a.v, b.v) >= {cluster.REPRINT} AND list_inner_product(a.v, b.v) < {cluster.DUP})
SELECT qid, p.id, round(sim, 5) AS sim, coalesce({text.near_title(DUCK, "x.title", "y.title")}, false) AS near_title, coalesce({text.near_description(DUCK, "x.text", "y.text")}, false) AS near_desc FROM p JOIN docs x ON x.id = qid JOIN docs y ON y.id = p.id"""


@query("vector_reprints", REPRINT_SQL)
def _(spark, folder):
    """Of every 50th document the documents within the band of a reprint, with their text evidence."""
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.expr("substr(split(text, '\\n')[0], 1, 60)").alias("title"), F.col("text").alias("desc"))
    index = neighbours.Index(embed.projected(docs, "desc"))
    pairs = staged(index.within(F.col("id") % 50 == 0, cluster.REPRINT, cluster.DUP), "reprint-pairs")
    return neighbours.reprinted(pairs, docs).withColumn("sim", F.round("sim", 5))


@query("vector_neighbours", f"WITH v AS ({_UNIT.format(id='vec_id', v='e', rows='SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings')}) SELECT a.id AS qid, b.id AS id, round(list_inner_product(a.v, b.v), 5) AS sim FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id WHERE list_inner_product(a.v, b.v) >= 0.3")
def _(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.Index(rows).within(F.col("id") % 50 == 0, 0.3).withColumn("sim", F.round("sim", 5))


# --- grades ----------------------------------------------------------------------------------

GRADED_SQL = f"WITH t AS (SELECT *, greatest(0, max(sem_score) OVER (PARTITION BY query_id)) AS top, max(CASE WHEN sem_score IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_score FROM ({CLUSTERS.sql})), g AS (SELECT *, greatest(0.5::DOUBLE, 0.6 * coalesce(top, 0)) AS edge, greatest(0.25::DOUBLE, 0.4 * coalesce(top, 0)) AS irrelevant FROM t), k AS (SELECT *, CASE WHEN sem_score IS NULL THEN 'unscored' WHEN sem_score >= edge THEN 'relevant' WHEN sem_score >= irrelevant THEN 'edge' ELSE 'irrelevant' END AS grade FROM g)"


@query("rel_thresholds", GRADED_SQL + " SELECT query_id, round(max(edge), 6) AS edge, round(max(irrelevant), 6) AS irrelevant FROM k GROUP BY query_id")
def _(spark, folder):
    g = grade.graded(CLUSTERS.df(spark, folder))
    return g.groupBy("query_id").agg(F.round(F.max("edge"), 6).alias("edge"), F.round(F.max("irrelevant"), 6).alias("irrelevant"))


@query("grade", GRADED_SQL + " SELECT query_id, cluster_id, grade, CASE WHEN text_score >= 0.5 THEN '标题/摘要含查询词但语义无关' ELSE '与查询主题无明显语义关联' END || '(语义 ' || coalesce(printf('%.2f', sem_score), '?') || ')' AS reason FROM k")
def _(spark, folder):
    return grade.reasons(grade.graded(CLUSTERS.df(spark, folder))).select("query_id", "cluster_id", "grade", "reason")


for _mode, _edge in (("balanced", "'edge'"), ("aggressive", "'collapsed'")):
    query(f"presentation_{_mode}", GRADED_SQL + f" SELECT query_id, cluster_id, CASE WHEN any_score = 0 OR grade = 'relevant' THEN 'shown' WHEN grade = 'edge' THEN {_edge} ELSE 'collapsed' END AS tier FROM k")(lambda spark, folder, m=_mode: grade.graded(CLUSTERS.df(spark, folder), m).select("query_id", "cluster_id", "tier"))


@query("collapsed_brief", GRADED_SQL + " SELECT query_id, string_agg('[' || label || ']×' || size, ' · ' ORDER BY cluster_id) AS brief FROM k WHERE any_score = 1 AND grade IN ('irrelevant', 'unscored') GROUP BY query_id")
def _(spark, folder):
    return grade.brief(grade.graded(CLUSTERS.df(spark, folder)))


# --- evidence and reputation -----------------------------------------------------------------

BAYES_SQL = f"""
WITH c AS (SELECT doc_id AS id, {text.body_tokens(DUCK, "text")} AS tokens FROM documents),
e AS (SELECT id, unnest(tokens) AS token, CASE WHEN quality = 1 THEN 0.82 ELSE 0.2 END AS label FROM c JOIN labels ON id = doc_id),
m AS (SELECT token, sum(CASE WHEN label > 0.6 THEN 0.8 ELSE 0 END)::DOUBLE AS good, sum(CASE WHEN label < 0.4 THEN 0.8 ELSE 0 END)::DOUBLE AS bad FROM e GROUP BY token)
"""


def _bayes(spark, folder):
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.expr(text.body_tokens(SPARK, "text")).alias("tokens"))
    rated = tables.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN quality = 1 THEN 0.82D ELSE 0.2D END").alias("label"))
    events = docs.join(rated, "id").withColumn("confidence", F.lit(0.8))
    return docs, evidence.bayes_gated(evidence.bayes_fit(events), rated)


@query("bayes_counts", BAYES_SQL + " SELECT token, round(good, 4) AS good, round(bad, 4) AS bad FROM m")
def _(spark, folder):
    return _bayes(spark, folder)[1].select("token", F.round("good", 4).alias("good"), F.round("bad", 4).alias("bad"))


@query("bayes_predict", BAYES_SQL + ", s AS (SELECT id, token, round((bad + 1) / (good + bad + 2), 12) AS p FROM (SELECT id, unnest(tokens) AS token FROM c) JOIN m USING (token)), r AS (SELECT *, count(*) OVER (PARTITION BY id) AS coverage, row_number() OVER (PARTITION BY id ORDER BY round(abs(p - 0.5), 12) DESC, token) AS nth FROM s WHERE abs(p - 0.5) > 0.05) SELECT id, max(coverage) AS coverage, round(1 / (1 + exp(sum(ln(1 - p)) - sum(ln(p)))), 6) AS prob FROM r WHERE coverage >= 4 AND nth <= 15 GROUP BY id")
def _(spark, folder):
    docs, model = _bayes(spark, folder)
    told = evidence.bayes_predict(docs, model)
    return told.select("id", "coverage", F.round("prob", 6).alias("prob"))


@query("evidence_chain", f"SELECT id, CASE WHEN label < 0.5 THEN 'local-content-v1' WHEN sem IS NOT NULL THEN 'semantic-v1' WHEN label IS NOT NULL THEN 'local-content-v1' WHEN prob >= 0.65 THEN 'bayes-v1' END AS final_source, round(CASE WHEN label < 0.5 OR (sem IS NULL AND label IS NOT NULL) THEN label WHEN sem IS NOT NULL THEN sem WHEN prob >= 0.65 THEN 0.35 END, 6) AS final_label FROM (SELECT id % 5 AS k, id, CASE id % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.82 WHEN 2 THEN 0.82 END::DOUBLE AS label, CASE WHEN id % 5 IN (0, 2) THEN 0.25 END::DOUBLE AS sem, CASE WHEN id % 5 >= 3 THEN (id % 5 - 3) * 0.5 + 0.3 END::DOUBLE AS prob FROM (SELECT doc_id AS id FROM documents))")
def _(spark, folder):
    rows = tables.table(spark, folder, "documents").selectExpr("doc_id AS id", "CASE doc_id % 5 WHEN 0 THEN 0.2D WHEN 1 THEN 0.82D WHEN 2 THEN 0.82D END AS label", "0.5D AS confidence", "CASE WHEN doc_id % 5 IN (0, 2) THEN 0.25D END AS sem_label", "0.4D AS sem_confidence", "CASE WHEN doc_id % 5 >= 3 THEN (doc_id % 5 - 3) * 0.5D + 0.3D END AS prob")
    return evidence.chain(rows).select("id", "final_source", F.round("final_label", 6).alias("final_label"))


OBSERVED_SQL = """
WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts AS t, CASE event_type WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'content' WHEN 'click' THEN 'select' ELSE 'fetch' END AS kind, CASE event_type WHEN 'error' THEN 0.0 WHEN 'signup' THEN 1.0 ELSE least(1.0, value / 100) END::DOUBLE AS value FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY t, id) AS i, count(*) OVER (PARTITION BY key, kind) AS n FROM o),
half AS (SELECT key, kind, 0.5 * pow(0.5, max(n)) + sum((CASE WHEN kind = 'fetch' THEN CASE WHEN value > 0 THEN 0.95 ELSE 0.1 END ELSE value END) * pow(0.5, n - i + 1)) AS score, max(n) AS n FROM n WHERE kind IN ('content', 'fetch') GROUP BY key, kind),
keys AS (SELECT key, count(*) FILTER (WHERE kind = 'search') AS search_samples, count(*) FILTER (WHERE kind = 'select') AS utility_samples FROM o GROUP BY key)
"""


@query("rep_scores", OBSERVED_SQL + " SELECT k.key, k.search_samples, k.utility_samples, round(coalesce(c.score, 0.5), 6) AS content_score, coalesce(c.n, 0) AS content_samples, round(coalesce(f.score, 0.5), 6) AS availability_score, coalesce(f.n, 0) AS availability_samples FROM keys k LEFT JOIN half c ON c.key = k.key AND c.kind = 'content' LEFT JOIN half f ON f.key = k.key AND f.kind = 'fetch'")
def _(spark, folder):
    e = reputation.learned(tables.observations(tables.table(spark, folder, "events")))
    return e.select("key", F.col("search_samples").cast("bigint").alias("search_samples"), F.col("utility_samples").cast("bigint").alias("utility_samples"), F.round("content_score", 6).alias("content_score"), F.col("content_samples").cast("bigint").alias("content_samples"), F.round("availability_score", 6).alias("availability_score"), F.col("availability_samples").cast("bigint").alias("availability_samples"))


@query("rep_search_fold", """
WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, least(1.0, value / 100)::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'),
f(key, i, s) AS (SELECT DISTINCT key, 0::BIGINT, 0.5::DOUBLE FROM o UNION ALL SELECT f.key, o.i, least(1.0, greatest(0.0, f.s + least(0.5, 1 / (1 + o.i * 0.12)) * (o.value - f.s))) FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
SELECT key, round(arg_max(s, i), 6) AS search_score FROM f GROUP BY key""")
def _(spark, folder):
    e = reputation.learned(tables.observations(tables.table(spark, folder, "events").where("event_type = 'view'")))
    return e.select("key", F.round("search_score", 6).alias("search_score"))


AS_OF_SQL = OBSERVED_SQL + """,
halves AS (SELECT o.key, o.kind, o.t::DATE AS day, row_number() OVER w AS i, CASE WHEN kind = 'fetch' THEN CASE WHEN value > 0 THEN 0.95 ELSE 0.1 END ELSE value END AS v FROM o WHERE kind IN ('content', 'fetch') WINDOW w AS (PARTITION BY key, kind ORDER BY t, id)),
grown AS (SELECT key, kind, day, i, pow(0.5, i) * (0.5 + sum(v * pow(2.0, i - 1)) OVER (PARTITION BY key, kind ORDER BY i)) AS s FROM halves),
days AS (SELECT key, kind, day + 1 AS day, max(i) AS n, arg_max(s, i) AS s FROM grown GROUP BY ALL),
asked AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, ts::DATE AS day FROM events WHERE event_type = 'click')
SELECT event_id, round(CASE WHEN any_day THEN coalesce(cs, 0.5) END + 1e-9, 6) AS content_score, coalesce(cn, 0) AS content_samples, round(CASE WHEN any_day THEN coalesce(fs, 0.5) END + 1e-9, 6) AS availability_score, coalesce(fn, 0) AS availability_samples
FROM (SELECT a.*, c.s AS cs, c.n AS cn FROM asked a ASOF LEFT JOIN (SELECT * FROM days WHERE kind = 'content') c ON a.key = c.key AND a.day >= c.day) ac
JOIN (SELECT a.event_id AS e2, f.s AS fs, f.n AS fn FROM asked a ASOF LEFT JOIN (SELECT * FROM days WHERE kind = 'fetch') f ON a.key = f.key AND a.day >= f.day) ON e2 = event_id
JOIN (SELECT event_id AS e3, EXISTS (SELECT 1 FROM o WHERE o.key = asked.key AND o.t::DATE < asked.day) AS any_day FROM asked) ON e3 = event_id"""


@query("rep_as_of", AS_OF_SQL)
def _(spark, folder):
    """The standing of every selected site before the day of its selection.

    Halving makes decimals that end in 5 one place beyond those shown; 1e-9 keeps them off the edge.
    """
    e = tables.table(spark, folder, "events")
    seen = tables.observations(e)
    asked = seen.where("kind = 'select'").select("key", "at", F.col("id").alias("event_id"))
    out = reputation.standing_as_of(asked, seen)
    return out.select("event_id", F.round(F.col("content_score") + 1e-9, 6).alias("content_score"), F.col("content_samples").cast("bigint").alias("content_samples"), F.round(F.col("availability_score") + 1e-9, 6).alias("availability_score"), F.col("availability_samples").cast("bigint").alias("availability_samples"))


FACTORS = Fixture("id bigint, score double, samples bigint, age double, avail double, avail_n bigint, uses bigint", [(1, 0.0, 10, 0.0, 0.5, 0, 0), (2, 0.5, 10, 29.0, 0.95, 5, 2), (3, 1.0, 10, 120.0, 0.1, 5, 5), (4, 0.8, 10, 60.0, 0.9, 2, 9), (5, 0.82, 5, 10.0, 0.5, 3, 3), (6, 0.31, 5, 45.0, 0.2, 4, 4), (7, 0.9, 2, 10.0, 0.5, 0, 0)])
FACTORS = rendered.all_of({"FACTORS": FACTORS})["FACTORS"]


@query("rep_factors", f"WITH d AS (SELECT *, CASE WHEN age <= 30 THEN score ELSE 0.5 + (score - 0.5) * (1 - least(1, greatest(0, (age - 30) / 60))) END AS s FROM ({FACTORS.sql})) SELECT id, round(s, 6) AS decayed, round(CASE WHEN samples < 3 THEN 1 ELSE least(1.15, greatest(0.35, 1 + (score - 0.5) * 1.6)) END, 6) AS factor, round(CASE WHEN avail_n < 3 THEN 1 ELSE least(1.05, greatest(0.75, 1 + (avail - 0.5) * 0.5)) END, 6) AS availability, round(CASE WHEN uses < 3 THEN 1 ELSE 1 + 0.03 * least(1, uses / 5) END, 6) AS utility, CASE WHEN samples < 3 THEN '' ELSE CASE WHEN score >= 0.65 THEN '✓' WHEN score <= 0.35 THEN '⚠' ELSE '·' END || '[rep:' || printf('%.2f', score) || ']' END AS badge FROM d")
def _(spark, folder):
    c = F.col
    return FACTORS.df(spark, folder).select("id", F.round(reputation.decayed(c("score"), c("age")), 6).alias("decayed"), F.round(reputation.factor(c("score"), c("samples")), 6).alias("factor"), F.round(reputation.availability_factor(c("avail"), c("avail_n")), 6).alias("availability"), F.round(reputation.utility_factor(c("uses")), 6).alias("utility"), reputation.badge(c("score"), c("samples")).alias("badge"))


@query("rep_contribution", f"WITH q AS (SELECT id, flags, {filters.quality(DUCK, 'flags')} AS q FROM (SELECT id, {filters.flags(DUCK, 'title', 'url', 'text', 'is_ad')} AS flags FROM ({RESULTS.sql}))) SELECT id, round(least(1, greatest(0.05, q * CASE WHEN list_has_any(flags, ['low:spam-title', 'low:spam-desc']) THEN 0.4 ELSE 1 END * CASE WHEN list_contains(flags, 'low:index-page') THEN 0.5 ELSE 1 END * CASE WHEN list_contains(flags, 'low:desc-empty') THEN 0.95 ELSE 1 END)), 6) AS contribution FROM q")
def _(spark, folder):
    rows = filters.annotate(RESULTS.df(spark, folder).withColumnRenamed("text", "desc"))
    return rows.select("id", F.round(reputation.contribution(F.col("quality"), F.col("flags")), 6).alias("contribution"))


@query("rep_lookup")
def _(spark, folder):
    rows = filters.annotate(merge.merged(_lists(spark, folder)))
    hosts = rows.select(F.explode(F.expr(urls.rep_keys(SPARK, "url"))).alias("key"), F.concat("query_id", F.lit("/"), "idx").alias("id"), F.lit(0).cast("bigint").alias("at"), F.lit("search").alias("kind"), reputation.contribution(F.col("quality"), F.col("flags")).alias("value"))
    entries = reputation.learned(hosts).withColumn("last_seen", F.lit(EVENTS_AS_OF).cast("date"))
    return reputation.applied(reputation.lookup(rows, entries, EVENTS_AS_OF)).select("query_id", "idx", "rep_score", "rep_samples", "rep_factor", "rep_badge", "rep_scope", F.round("quality", 6).alias("quality"))


FEATURES_SQL = f"SELECT page_id AS id, unnest({DUCK.chain(DUCK.each(text.words_mixed(DUCK, pages.title(DUCK, 'html')), 'w', DUCK.lit('t:') + ' || w'), urls.tokens(DUCK, 'url'))}) AS token FROM pages"


@query("feature_weights", f"SELECT id, token, round(1.0 / count(*) OVER (PARTITION BY id, substr(token, 1, 2)), 6) AS x FROM ({FEATURES_SQL}) WHERE token LIKE 't:%' OR token LIKE 'u:%'")
def _(spark, folder):
    p = tables.table(spark, folder, "pages").select(F.col("page_id").alias("id"), "url", F.expr(pages.title(SPARK, "html")).alias("title"))
    rows = p.select("id", F.expr(f"concat(transform({text.words_mixed(SPARK, 'title')}, w -> concat('t:', w)), {urls.tokens(SPARK, 'url')})").alias("tokens"))
    return reputation.feature_weights(rows).select("id", "token", F.round("x", 6).alias("x"))


@query("ftrl_prior")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").join(tables.table(spark, folder, "labels"), "doc_id")
    own = docs.select(F.concat("lang", F.lit("/"), "source").alias("model"), F.col("doc_id").alias("at"), F.col("doc_id").cast("string").alias("id"), F.expr("CASE WHEN quality = 1 THEN 0.82D ELSE 0.2D END").alias("label"), F.lit(0.8).alias("confidence"), F.expr(f"transform({text.words_mixed(SPARK, 'substr(text, 1, 60)')}, w -> concat('t:', w))").alias("tokens"))
    return reputation.fit_prior(own)


@query("backtest_metrics", "WITH p AS (SELECT doc_id, (CAST('0x' || substr(sha256(source), 1, 2) AS INTEGER) % 5)::BIGINT AS fold, CASE WHEN quality = 1 THEN 0.82 ELSE 0.2 END::DOUBLE AS label, ((doc_id * 37) % 100) / 100.0::DOUBLE AS pred FROM labels JOIN documents USING (doc_id)) SELECT fold, count(*) AS n, round(avg((pred - label) * (pred - label)), 6) AS brier, round(avg((0.5 - label) * (0.5 - label)), 6) AS neutral_brier, round(avg(abs(pred - label)), 6) AS mae, round(avg(CASE WHEN pred <= 0.4 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label <= 0.35), 6) AS low_recall, round(avg(CASE WHEN pred <= 0.4 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label >= 0.65), 6) AS good_fpr FROM p GROUP BY fold")
def _(spark, folder):
    p = tables.table(spark, folder, "labels").join(tables.table(spark, folder, "documents"), "doc_id").select(reputation.fold(F.col("source")).alias("fold"), F.expr("CASE WHEN quality = 1 THEN 0.82D ELSE 0.2D END").alias("label"), F.expr("((doc_id * 37) % 100) / 100.0D").alias("pred"))
    m = reputation.metrics(p)
    return m.select("fold", "n", *(F.round(c, 6).alias(c) for c in ("brier", "neutral_brier", "mae", "low_recall", "good_fpr")))


# --- pages -----------------------------------------------------------------------------------

DATED_PAGES = Fixture("page_id bigint, url string, html string, title string, body_len bigint", [
    (1, "https://a.com/x", '<meta property="article:published_time" content="2026-08-01T10:00"><article>text</article>', "Story", 2000), (2, "https://a.com/n1/2026/0807/c1.html", '<meta name="date" content="2025-05-01"><article>x</article>', "Story", 2000), (3, "https://a.com/", '<meta property="article:published_time" content="2018-03-28"><a href=1></a><a href=2></a><a href=3></a>', "新闻频道", 100),
    (4, "https://a.com/x", "<p>发布时间：2026年8月6日</p><p>x</p>", "Story", 500), (5, "https://a.com/x", "<p>no date</p>", "Story", 500), (6, "https://a.com/list", '<time datetime="2026-08-07"></time><time datetime="2026-08-05"></time><meta property="article:published_time" content="2018-03-28">', "新闻", 100), (7, "https://a.com/y", '<script type="application/ld+json">{"datePublished":"2026-08-03"}</script><script>pubDate: "2026-08-03"</script>', "Story", 1500),
])


_DAY, _SOURCE = rendered.stated(DUCK)


def _page_rows(spark, folder):
    """Stored pages that state a day (``rendered.dated_pages``), with what dating needs of them."""
    p = tables.table(spark, folder, "pages").selectExpr(*(f"{e} AS {n}" for n, e in rendered.dated_pages(SPARK).items()))
    return p.select("page_id", "url", "html", F.expr(pages.title(SPARK, "html")).alias("title"), F.expr(f"CAST(length({pages.body(SPARK, 'html')}) AS BIGINT)").alias("body_len"))


@query("date_candidates", f"SELECT page_id, {_DAY} AS date, {_SOURCE} AS source, {_SOURCE} = 'body-ctx' AS strong FROM pages WHERE {_SOURCE} <> 'none' UNION ALL SELECT page_id, {_DAY}, 'meta-generic', false FROM pages WHERE page_id % 8 = 6")
def _(spark, folder):
    return pubdate.candidates(_page_rows(spark, folder)).select("page_id", "date", "source", "strong")


PICKED = Fixture("page_id bigint, date string, source string", [(1, "2026-08-01", "meta-article"), (2, "2026-08-07", "url"), (3, "", "none"), (4, "2026-08-06", "body-ctx"), (5, "", "none"), (6, "2026-08-07", "list-time"), (7, "2026-08-03", "jsonld")])


@query("pick_date", PICKED.sql)
def _(spark, folder):
    p = DATED_PAGES.df(spark, folder)
    return pubdate.pick(pubdate.candidates(p), pubdate.features(p)).select("page_id", "date", "source")


@query("pick_date_pages", f"SELECT page_id, {_DAY} AS date, {_SOURCE} AS source FROM pages")
def _(spark, folder):
    p = _page_rows(spark, folder)
    return pubdate.pick(pubdate.candidates(p), pubdate.features(p)).select("page_id", "date", "source")


@query("date_consensus", Fixture("page_id bigint, date string, votes bigint", [(-7, "2026-08-03", 2)]).sql + f" UNION ALL SELECT page_id, {_DAY}, 2 FROM pages WHERE page_id % 8 = 6")
def _(spark, folder):
    literal = DATED_PAGES.df(spark, folder).withColumn("page_id", -F.col("page_id"))
    return pubdate.consensus(pubdate.candidates(literal.unionByName(_page_rows(spark, folder))))


@query("parse_tier", f"SELECT id, CASE WHEN specific > 0 AND specific / greatest(1, least(most, coalesce(entries, most))) >= 0.5 THEN 'specific' WHEN specific >= 5 AND specific >= generic THEN 'specific' WHEN generic > specific THEN 'generic' WHEN specific > 0 THEN 'specific' WHEN stream > 0 THEN 'urlstream' ELSE 'none' END AS parsed_by FROM ({TIERS.sql})")
def _(spark, folder):
    return links.parse_tier(TIERS.df(spark, folder).withColumnRenamed("most", "limit")).select("id", "parsed_by")


@query("page_anchors", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style).*?</(script|style)>', '', 'g'), '(?i)<a\\s[^>]*href', 0)) FROM pages) GROUP BY page_id")
def _(spark, folder):
    return serp.anchors(tables.table(spark, folder, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


SERP_HTML = Fixture("page_id bigint, engine string, html string", [
    (1, "bing", '<ol><li class="b_algo"><h2><a href="https://a.com/1">First result</a></h2><div class="b_caption"><p>About 2026-08-01 the first</p></div></li><li class="b_algo"><h2><a href="https://cn.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS8">Second</a></h2></li></ol>'),
    (2, "so360", '<li class="res-list"><h3 class="res-title"><a href="https://www.so.com/link?m=1">三六零 结果</a></h3><a data-mdurl="https://b.com/x"></a><span class="res-list-summary">摘要</span><span class="g-c-gray">2026年1月5日</span></li><li class="res-list"><div class="lianmeng-ad"></div><h3 class="res-title"><a href="https://ad.com">ad</a></h3></li>'),
    (3, "sogou-wechat", "<li id='sogou_vr_1'><h3><a href='/link?url=abc'>公众号文章</a></h3><p class='txt-info'>内容</p><span class='all-time-y2'>某号</span><script>document.write(timeConvert('1774784784'))</script></li>"),
    (4, "sm", '<div class="qk-card"><a class="qk-link-wrapper" href="https://c.com/1"><div class="qk-title-text">神马 标题</div></a><div class="qk-paragraph-text">段落</div></div><div class="qk-card"><a class="qk-link-wrapper" href="https://m.sm.cn/x"><div class="qk-title-text">内部</div></a></div>'),
    (5, "marginalia", "<section class='card'><h2 class='text-md'><a href='https://d.org/'>Old page</a></h2><p>Plain text</p></section>"), (6, "searx", '<article class="result"><h3><a href="https://e.com/">Searched</a></h3><p class="content">body</p></article>'), (7, "bing", "请输入验证码"),
])
SERP_ROWS = Fixture("page_id bigint, pos int, title string, url string, desc_text string, date string, account string", [
    (1, 1, "First result", "https://a.com/1", "About 2026-08-01 the first", "2026-08-01", None), (1, 2, "Second", "https://example.com/", "", None, None), (2, 1, "三六零结果", "https://b.com/x", "摘要", "2026-01-05", None), (3, 1, "公众号文章", "https://weixin.sogou.com/link?url=abc", "内容", "2026-03-29", "某号"), (4, 1, "神马标题", "https://c.com/1", "段落", None, None), (5, 1, "Old page", "https://d.org/", "Plain text", None, None), (6, 1, "Searched", "https://e.com/", "body", None, None),
])


@query("serp_parsers", SERP_ROWS.sql)
def _(spark, folder):
    return serp.parse(SERP_HTML.df(spark, folder)).select("page_id", "pos", "title", "url", F.col("desc").alias("desc_text"), "date", "account")


BOARDS = Fixture("page_id bigint, engine string, html string", [
    (1, "toutiao", '{"data":[{"Title":"热点一","Url":"https://www.toutiao.com/t/1?x=2","HotValue":"16731403"},{"Title":"热点二","ClusterIdStr":"77","HotValue":"900"}]}'), (2, "baidu", '{"data":{"cards":[{"content":[{"content":[{"word":"词","url":"https://b.com/","hotScore":"123456"}]}]}]}}'),
    (3, "douyin", '<a href="/hot/1"><h3>抖音热点</h3></a><a href="/user/2"><h3>no</h3></a>'), (4, "github", '<article class="Box-row"><h2><a href="/o/r">o / r</a></h2><span>1,234 stars today</span></article><article class="Box-row"><h2><a href="/trending/x">x</a></h2></article>'), (5, "weibo", '<table><tr><td class="td-01">1</td><td><a href="/weibo?q=x">热搜</a><span>20000</span></td></tr></table>'), (6, "toutiao", "not json"),
])
BOARD_ROWS = Fixture("page_id bigint, rank int, name string, url string, heat string", [(1, 1, "热点一", "https://www.toutiao.com/t/1", "1673.1万"), (1, 2, "热点二", "https://www.toutiao.com/trending/77/", "900"), (2, 1, "词", "https://b.com/", "12.3万"), (3, 1, "抖音热点", "https://www.douyin.com/hot/1", ""), (4, 1, "o/r", "https://github.com/o/r", "1,234"), (5, 1, "热搜", "https://s.weibo.com/weibo?q=x", "2.0万")])


@query("hotlists", BOARD_ROWS.sql)
def _(spark, folder):
    return serp.boards(BOARDS.df(spark, folder)).select("page_id", "rank", "name", "url", "heat")


JSONS = Fixture("page_id bigint, engine string, html string", [(1, "hn", '{"hits":[{"title":"Show HN","url":"https://h.com","points":12,"author":"me","created_at":"2026-08-01T00:00:00Z"}]}'), (2, "github", '{"items":[{"full_name":"a/b","html_url":"https://github.com/a/b","description":null,"updated_at":"2026-07-01T00:00:00Z"}]}'), (3, "wikipedia", '{"query":{"search":[{"title":"Red panda","snippet":"<b>Red</b> panda","timestamp":"2026-01-02T00:00:00Z"}]}}'), (4, "searx", '{"results":[{"title":"T","url":"https://s.com","content":"c","engine":"ddg"}]}'), (5, "hn", "broken")])
JSON_ROWS = Fixture("page_id bigint, title string, url string, desc_text string, date string", [(1, "Show HN", "https://h.com", "12 points · me", "2026-08-01"), (2, "a/b", "https://github.com/a/b", "", "2026-07-01"), (3, "Red panda", "https://en.wikipedia.org/wiki/Red_panda", "Red panda", "2026-01-02"), (4, "T", "https://s.com", "c [via ddg]", None)])


@query("json_sources", JSON_ROWS.sql)
def _(spark, folder):
    return serp.parse_json(JSONS.df(spark, folder)).select("page_id", "title", "url", F.col("desc").alias("desc_text"), "date")


STREAMED = Fixture("page_id bigint, engine string, html string", [(1, "x", '<script>window.__INITIAL_STATE__ = {"list":[{"id":1,"title":"An embedded title","link":"https://z.com/article/1?x=1","abstract":"Words"},{"id":2,"name":"Other","link":"https://z.com/article/2"}]};</script>')])


@query("json_walk", Fixture("page_id bigint, title string, url string, desc_text string", [(1, "An embedded title", "https://z.com/article/1?x=1", "Words"), (1, "Other", "https://z.com/article/2", "")]).sql)
def _(spark, folder):
    return serp.url_stream(STREAMED.df(spark, folder), r"/article/\d+").select("page_id", "title", "url", F.col("desc").alias("desc_text"))


LIST_HTML = Fixture("page_id bigint, engine string, html string", [(1, "x", "<nav><a href='https://n.com/2026/08/01/a.html'>Navigation link</a></nav><ul>" + "".join(f"<li><a href='https://n.com/2026/08/0{i}/story.html'>Story number {i}</a><p>Something to read about it</p></li>" for i in range(1, 6)) + "<li><a href='https://n.com/a/b/long.html'>Undated story</a><p>x</p></li></ul>")])


@query("serp_generic", Fixture("page_id bigint, url string, title string", [(1, f"https://n.com/2026/08/0{i}/story.html", f"Story number {i}") for i in range(1, 6)] + [(1, "https://n.com/a/b/long.html", "Undated story")]).sql)
def _(spark, folder):
    return links.generic_results(serp.anchors(LIST_HTML.df(spark, folder))).select("page_id", "url", "title")


@query("link_list", Fixture("page_id bigint, place int, url string, date string", [(1, 6 - i, f"https://n.com/2026/08/0{i}/story.html", f"2026-08-0{i}") for i in range(1, 6)] + [(1, 6, "https://n.com/a/b/long.html", None)]).sql)
def _(spark, folder):
    return links.link_list(serp.anchors(LIST_HTML.df(spark, folder))).select("page_id", "place", "url", "date")


# --- streams ---------------------------------------------------------------------------------


@query("daily_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(spark, folder):
    return state.windowed(tables.table(spark, folder, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("sessions", "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e) SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM s GROUP BY user_id, nth")
def _(spark, folder):
    return state.sessions(tables.table(spark, folder, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("daily_dedupe", "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(spark, folder):
    return state.daily_distinct(tables.table(spark, folder, "events")).withColumn("day", F.col("day").cast("string"))


@query("rate_limit", "SELECT event_id, round(greatest(0, coalesce(1500 - (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0, 0)), 3) AS delay_ms FROM events")
def _(spark, folder):
    e = state.rate_delay(tables.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.col("user_id")))
    return e.select("event_id", F.round("delay_ms", 3).alias("delay_ms"))


@query("cooldown", "WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f(key, i, fails, until, trips) AS (SELECT DISTINCT key, 0::BIGINT, 0, 0.0::DOUBLE, 0 FROM o UNION ALL SELECT f.key, o.i, CASE WHEN o.ok OR f.fails + 1 >= 2 THEN 0 ELSE f.fails + 1 END, CASE WHEN o.ok THEN 0.0 WHEN f.fails + 1 >= 2 THEN o.at + 300 ELSE f.until END, f.trips + CASE WHEN NOT o.ok AND f.fails + 1 >= 2 THEN 1 ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1) SELECT key, arg_max(fails, i) AS fails, round(arg_max(until, i), 3) AS cooled_until, arg_max(trips, i) AS trips FROM f GROUP BY key")
def _(spark, folder):
    e = tables.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return state.cooldown(e, 2).select("key", "fails", F.round("cooled_until", 3).alias("cooled_until"), "trips")


@query("ttl_cache", "SELECT a.event_id, (SELECT arg_max(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts AND a.ts - b.ts < INTERVAL 6 HOUR) AS cached FROM events a WHERE a.event_type = 'view'")
def _(spark, folder):
    e = tables.table(spark, folder, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    asked = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), "at", "event_id")
    saved = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("at").alias("saved_at"), F.col("event_id").alias("value"))
    return state.cached(asked, saved, 6 * 3600.0).select("event_id", F.col("value").alias("cached"))


# --- plans -----------------------------------------------------------------------------------


@query("search")
def _(spark, folder):
    """The whole plan: what earlier results say of sites scales quality, reprints fold, clusters are graded."""
    lists = staged(_lists(spark, folder), "search-lists")  # pages are parsed once
    rows = staged(filters.annotate(merge.merged(tables.asked(lists, tables.title_queries(lists)))), "search-annotated")
    seen = rows.select(F.explode(F.expr(urls.rep_keys(SPARK, "url"))).alias("key"), F.concat("query_id", F.lit("/"), "idx").alias("id"), F.lit(0).cast("bigint").alias("at"), F.lit("search").alias("kind"), reputation.contribution(F.col("quality"), F.col("flags")).alias("value"))
    entries = reputation.learned(seen).withColumn("last_seen", F.lit(AS_OF).cast("date"))
    return search.found(rows.where(F.col("idx") < search.LIMIT), AS_OF, entries=entries)


STORED = f"SELECT url, arg_min({text.first_paragraph(DUCK, text.strip_tags(DUCK, 'html'))}, page_id) AS first, {rendered.stated(DUCK, 'min(page_id)')[0]} AS published FROM pages GROUP BY url"


@query("timeline", LISTS_SQL + f"SELECT query_id, page_id, substr(coalesce(nullif(published, ''), {dates.url_date(DUCK, 'url')}), 1, 7) AS month, title, coalesce(nullif(first, ''), substr(text, 1, 150)) AS summary, row_number() OVER (PARTITION BY query_id ORDER BY nullif(coalesce(nullif(published, ''), {dates.url_date(DUCK, 'url')}), '') NULLS LAST, idx) AS place FROM merged LEFT JOIN ({STORED}) USING (url)")
def _(spark, folder):
    """Results by the day that their stored page states, as dating finds it."""
    rows = merge.merged(_lists(spark, folder))
    own = _page_rows(spark, folder)
    picked = pubdate.pick(pubdate.candidates(own), pubdate.features(own)).select("page_id", F.col("date").alias("published"))
    stored = tables.table(spark, folder, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    extracts = stored.join(picked, "page_id").select("url", F.expr(text.strip_tags(SPARK, "html")).alias("markdown"), "published")
    out = search.timeline(rows, extracts, AS_OF)
    return out.join(rows.select("query_id", "url", "page_id"), ["query_id", "url"]).select("query_id", "page_id", F.coalesce("month", F.lit("")).alias("month"), "title", "summary", "place")


# --- judgements, retention, news, display ----------------------------------------------------

from ..operators import judge, news, retention  # noqa: E402
from ..sources import article  # noqa: E402

SCORES = Fixture("url string, score double, at string", [("https://a.com/1", 0.9, "2026-08-01"), ("https://a.com/1", 0.2, "2026-08-05"), ("https://b.com/1", 0.4, "2026-01-01")])
JUDGED = Fixture("query_id bigint, idx bigint, url string", [(1, 0, "https://a.com/1"), (1, 1, "https://b.com/1"), (2, 0, "https://c.com/1")])
NEWS = Fixture("query_id bigint, query string, pos bigint, title string, url string", [(1, "经济 增长", 1, "经济运行总体平稳向好发展", "https://n.cn/2026/0801/a.html"), (1, "经济 增长", 2, "经济运行总体平稳,向好发展", "https://n.cn/2026/0802/b.html"), (1, "经济 增长", 3, "体育新闻今日要点汇总", "https://n.cn/2026/0803/c.html"), (1, "经济 增长", 4, "增长动能持续增强的背后", "https://n.cn/x.html"), (1, "经济 增长", 5, "经济去年全年数据回顾", "https://n.cn/2025/0101/d.html"), (1, "经济 增长", 6, "短经济", "https://n.cn/2026/0804/e.html")])


@query("judge_shards", LISTS_SQL + "SELECT query_id, idx, CAST(floor(idx / 12) AS BIGINT) AS shard FROM merged")
def _(spark, folder):
    return judge.shards(merge.merged(_lists(spark, folder))).select("query_id", "idx", "shard")


@query("judge_scores", f"SELECT query_id, idx, coalesce(s, 0.5) AS judge_score, s IS NOT NULL AS judged FROM ({JUDGED.sql}) LEFT JOIN (SELECT url, arg_max(score, \"at\") AS s FROM ({SCORES.sql}) WHERE date_diff('day', CAST(\"at\" AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 30 GROUP BY url) USING (url)")
def _(spark, folder):
    return judge.judged(JUDGED.df(spark, folder), SCORES.df(spark, folder), AS_OF).select("query_id", "idx", "judge_score", "judged")


@query("judge_refreshes", LISTS_SQL + "SELECT query_id, idx FROM merged WHERE idx < 3 OR CAST('0x' || substr(sha256(url), 1, 2) AS INTEGER) < 13")
def _(spark, folder):
    rows = merge.merged(_lists(spark, folder)).withColumn("samples", F.when(F.col("idx") < 3, 0).otherwise(9))
    return judge.refreshes(rows).select("query_id", "idx")


@query("retain_events", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events) WHERE nth <= 20")
def _(spark, folder):
    return retention.newest(tables.table(spark, folder, "events"), [F.desc("ts"), F.col("event_id")], 20, ["user_id"]).select("event_id")


@query("retain_halved", "SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE n <= 60 OR nth > 30")
def _(spark, folder):
    return retention.halved(tables.table(spark, folder, "events"), [F.col("ts"), F.col("event_id")], 60, ["user_id"]).select("event_id")


@query("news_list", Fixture("query_id bigint, place int, title string, url string, date string", [(1, 1, "经济运行总体平稳,向好发展", "https://n.cn/2026/0802/b.html", "2026-08-02"), (1, 2, "增长动能持续增强的背后", "https://n.cn/x.html", None)]).sql)
def _(spark, folder):
    return news.news(NEWS.df(spark, folder), AS_OF)


@query("query_prefixes", f"SELECT id AS query_id, k AS words, array_to_string(ws[1:k], ' ') AS prefix FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT id, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '') AS ws FROM ({ASKED.sql})))")
def _(spark, folder):
    return news.prefixes(ASKED.df(spark, folder).selectExpr("id AS query_id", "q AS query"))


@query("query_relaxation", f"SELECT id AS query_id, max(k) AS words FROM (SELECT id, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT id, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '') AS ws FROM ({ASKED.sql}))) WHERE k <= 2 GROUP BY id")
def _(spark, folder):
    asked = news.prefixes(ASKED.df(spark, folder).selectExpr("id AS query_id", "q AS query"))
    return news.relaxed(asked.withColumn("n", F.when(F.col("words") <= 2, 1).otherwise(0)))


@query("result_display", LISTS_SQL + """SELECT query_id, idx, NOT (idx % 7 = 0 OR len(list_filter(flags, lambda f: f LIKE 'low:spam%')) > 0) AS show_url,
  CASE WHEN idx % 7 = 0 OR len(list_filter(flags, lambda f: f LIKE 'low:%' AND f <> 'low:stale')) > 0 THEN '' WHEN idx % 2 = 0 THEN substr(text, 1, 120) ELSE text END AS show_desc FROM noted""")
def _(spark, folder):
    rows = filters.annotate(merge.merged(_lists(spark, folder))).withColumn("low_relevance", F.col("idx") % 7 == 0).withColumn("tier", F.when(F.col("idx") % 2 == 0, "edge").otherwise("shown"))
    return news.shown(rows).select("query_id", "idx", "show_url", "show_desc")


@query("list_body", Fixture("page_id bigint, body string, newest string, dated bigint", [(1, "\n".join(f"2026-08-0{i} Story number {i}" for i in range(5, 0, -1)) + "\nUndated story", "2026-08-05", 5)]).sql)
def _(spark, folder):
    return news.list_body(links.link_list(serp.anchors(LIST_HTML.df(spark, folder))))


@query("readable_body")
def _(spark, folder):
    return article.articles(tables.table(spark, folder, "pages"))


from . import cases, measured, roundtrip  # noqa: E402, F401
