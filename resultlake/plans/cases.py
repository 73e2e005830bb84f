"""Queries over literal rows, each with the literal rows that it must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.dialect import DUCK, SPARK
from ..operators import cluster, embed, evidence, grade, merge, pages, pubdate, reputation
from ..sources import embedded
from ..streaming import state
from . import rendered, search
from .catalog import AS_OF, Fixture, query


def expected(name: str, rows: Fixture):
    """A query whose result is these rows."""
    return query(name, rows.sql)


def told(base: Fixture, want: Fixture, name: str, keys: list[str], also: tuple[str, dict] | None = None, **built):
    """A query of scalar functions over literal rows, and over rows rendered from a table (``also``: it and the columns).

    The literal rows must come out as ``want``, the table's as the same functions give them on DuckDB.
    """
    at = lambda f, d: f(d) if callable(f) else f
    if also is None:
        expected(name, want)(lambda spark, folder: base.df(spark, folder).select(*keys, *(F.expr(at(f, SPARK)).alias(k) for k, f in built.items())))
        return
    rows = rendered.Rendered(base, also[0], **also[1])
    own = ", ".join([*keys, *(f"{at(f, DUCK)} AS {k}" for k, f in built.items())])
    literal = ", ".join([*keys, *built])
    twin = f"SELECT {literal} FROM ({want.sql}) UNION ALL SELECT {own} FROM (SELECT {', '.join(rows._columns(DUCK))} FROM {also[0]})"
    query(name, twin)(lambda spark, folder: rows.df(spark, folder).select(*keys, *(F.expr(at(f, SPARK)).alias(k) for k, f in built.items())))


# --- texts and URLs --------------------------------------------------------------------------

told(
    Fixture("id bigint, s string", [(1, "caf&#233; &#8211; &#x27;a&#x27;"), (2, "&#20013;&#x6587;"), (3, "&#128512;"), (4, "&#0; &#xD800; &#9999999;"), (5, "&amp;lt; &#38;amp;")]),
    Fixture("id bigint, decoded string", [(1, "café – 'a'"), (2, "中文"), (3, "😀"), (4, "&#0; &#xD800; &#9999999;"), (5, "&lt; &amp;")]),
    "entities_numeric", ["id"], decoded=text.decode_entities(SPARK, "s"),
)
told(
    Fixture("id bigint, s string", [(1, "<b>Fish</b> &amp; chips&nbsp;now"), (2, "it&apos;s &quot;it&quot;  \n x"), (3, "")]),
    Fixture("id bigint, s string", [(1, "Fish & chips now"), (2, "it's \"it\" x"), (3, "")]),
    "light_clean", ["id"], ("pages", {"id": "page_id + 1000", "s": "html"}), s=lambda d: text.light_clean(d, "s"),
)
told(
    Fixture("id bigint, title string, q string", [(1, "a" * 300, " tide tables "), (2, None, "x" * 300)]),
    Fixture("id bigint, n int, head string, asked int", [(1, 204, "aaaa", 14), (2, 3, "end", 259)]),
    "embedded_heads", ["id"], n=f"length({text.embedded_text(SPARK, 'title', chr(39) + 'end' + chr(39))})", head=f"substr({text.embedded_text(SPARK, 'title', chr(39) + 'end' + chr(39))}, 1, 4)", asked=f"length({text.embedded_query(SPARK, 'q')})",
)
told(
    Fixture("id bigint, title string, label string", [(1, "OpenAI ships a model", "openai"), (2, "The pencil case", "pen"), (3, "a pen, please", "Pen"), (4, "大模型发布会", "模型"), (5, "x", "")]),
    Fixture("id bigint, holds boolean", [(1, True), (2, False), (3, True), (4, True), (5, False)]),
    "label_holds", ["id"], ("documents", {"id": "doc_id + 1000", "title": rendered.title, "label": rendered.forms("doc_id", rendered.B, rendered.A, "'the'")}), holds=lambda d: text.holds_label(d, "title", "label"),
)
told(
    Fixture("id bigint, value string", [(1, "openai"), (2, "lake"), (3, "中文"), (4, "none")]),
    Fixture("id bigint, value string", [(1, "OpenAI"), (2, "Lake"), (3, "中文"), (4, "none")]),
    "label_casing", ["id"], value=text.as_in_titles(SPARK, "value", "array('News of OpenAI', 'Great Lake', 'the lake')"),
)
told(
    Fixture("id bigint, title string, label string", [(1, "Harbour tides - tables for July", "tides"), (2, "alone|alone", ""), (3, "Harbour tides", "tides")]),
    Fixture("id bigint, span string", [(1, "tables"), (2, "alone"), (3, "Harbour")]),
    "label_own_segment", ["id"], span=text.own_segment(SPARK, "title", "array('Harbour tides today', 'Harbour news')", "label"),
)
told(
    Fixture("id bigint, url string", [(1, "https://m.t.com/group/71/?channel=a&id=2&utm_source=b"), (2, "https://m.t.com/group/71/?source=x"), (3, "https://m.t.com/group/71/?a=1")]),
    Fixture("id bigint, url string", [(1, "https://m.t.com/group/71/&id=2"), (2, "https://m.t.com/group/71/"), (3, "https://m.t.com/group/71/?a=1")]),
    "url_scrub", ["id"], ("pages", {"id": "page_id + 1000", "url": "'https://m.t.com/group/' || page_id || '/?channel=a&id=2&utm_source=b'"}), url=lambda d: urls.scrubbed(d, "url"),
)

# --- pages -----------------------------------------------------------------------------------

told(
    Fixture("id bigint, html string", [(1, "var o = {cType: 'managed'}"), (2, 'var o = {cType: "managed"}'), (3, "<title>Just a moment...</title>"), (4, "all fine")]),
    Fixture("id bigint, kind string, family boolean", [(1, "cloudflare-turnstile", True), (2, None, False), (3, "cloudflare-interstitial", True), (4, None, False)]),
    "antibot_family", ["id"], ("pages", {"id": "page_id + 1000", "html": rendered.forms("page_id", "html", "'<title>Just a moment...</title>' || html")}), kind=lambda d: pages.antibot(d, "html"), family=lambda d: pages.cloudflare(d, pages.antibot(d, "html")),
)
told(
    Fixture("id bigint, status int, message string", [(1, 403, None), (2, 404, "timeout"), (3, 503, None), (4, None, "Socket hang up"), (5, None, "no body"), (6, None, "certificate has expired"), (7, 429, "TLS")]),
    Fixture("id bigint, mirror boolean, tls boolean", [(1, True, True), (2, False, False), (3, True, False), (4, True, False), (5, False, False), (6, False, True), (7, True, False)]),
    "failure_kinds", ["id"], ("events", {"id": "event_id + 1000", "status": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE 200 + CAST(floor(value) AS INT) % 400 END", "message": "event_type"}), mirror=lambda d: pages.mirror_fault(d, "status", "message"), tls=lambda d: pages.tls_fallback(d, "status", "message"),
)
told(
    Fixture("id bigint, html string, url string", [(1, '<meta property="article:published_time" content="2026-03-04T08:00:00Z">2020-01-01', "https://a.com/2025/0102/x"), (2, "on 2020-01-01", "https://a.com/2025/0102/x"), (3, "on 2020年1月5日", "https://a.com/x"), (4, "never", "https://a.com/x")]),
    Fixture("id bigint, day string", [(1, "2026-03-04"), (2, "2025-01-02"), (3, "2020-01-05"), (4, "")]),
    "published_simple", ["id"], day=pages.published_simple(SPARK, "html", "url"),
)

FAILURES = Fixture("url string, status int, message string", [("a", 503, None), ("a", None, "timeout"), ("b", 503, None), ("b", 404, None), ("c", 200, None)])


@expected("mirrors_cool", Fixture("url string, cool boolean", [("a", True), ("b", False), ("c", False)]))
def _(spark, folder):
    return pages.mirrors_cool(FAILURES.df(spark, folder))


COPIES = Fixture("url string, nth int, mirror string, body string", [("a", 2, "second", "two"), ("a", 1, "first", ""), ("a", 3, "third", "three"), ("b", 1, "first", "one"), ("c", 1, "first", None)])


@expected("archived_copy", Fixture("url string, mirror string, body string", [("a", "second", "two"), ("b", "first", "one")]))
def _(spark, folder):
    return pages.archived(COPIES.df(spark, folder))


SCANNED = Fixture("url string, content_type string, html string, elapsed_ms bigint, kind string", [("a", "text/html; charset=utf-8", "<p>é</p>", 900, "full"), ("b", "application/pdf", "%PDF", 100, "full"), ("c", "text/markdown", "# x", 12500, "full"), ("d", "text/plain", "x", 12000, "truncated")])


@expected("page_scan", Fixture("url string, html_bytes bigint", [("a", 9), ("c", 3), ("d", 1)]))
def _(spark, folder):
    return pages.scanned(SCANNED.df(spark, folder)).select("url", "html_bytes")


@expected("fetch_budget", Fixture("url string", [("a",), ("b",)]))
def _(spark, folder):
    return pages.cacheable(pages.fetched_in_time(SCANNED.df(spark, folder), 12_000)).select("url")


STREAM = '{"title":"A story of the northern harbour","ttsearch_msite_url":"https://m.t.com/group/71/?channel=x","summary_text":"What the harbour did","publish_time":"1785888000"}' + " " * 6000
STREAM += '{"title":"far"}' + "." * 5200 + '{"ttsearch_msite_url":"https://m.t.com/group/72/","show_title":"Second \\\\u0026 near"}{"ttsearch_msite_url":"https://m.t.com/group/71/?again"}'


@expected("stream_results", Fixture("page_id bigint, pos int, title string, url string, date string, entries int", [(1, 0, "A story of the northern harbour", "https://m.t.com/group/71/", "2026-08-05", 3), (1, 1, "Second & near", "https://m.t.com/group/72/", "", 3)]))
def _(spark, folder):
    return embedded.stream_results(Fixture("page_id bigint, html string", [(1, STREAM.replace("\\\\u", "\\u")), (2, "")]).df(spark, folder)).select("page_id", "pos", "title", "url", "date", "entries")


NEWS_PAGE = """<a href="/n1/2026/0803/c1.html">港口扩建工程今日正式开工建设</a><a href='//politics.people.com.cn/n1/2026/0804/c2.html'><b>沿海城市迎来新的航线网络</b></a>
<a href="/n1/2026/0803/c1.html">港口扩建工程今日正式开工建设</a><a href="/GB/1.html">资料汇编收录历年文件全文</a><a href="/n1/2026/0805/c3.html">短标题</a><a href="/n1/2026/0806/c4.html">欢迎您访问本站的首页栏目</a><a href="mailto:x">给编辑部写一封长长的信</a>"""


@expected("news_links", Fixture("page_id bigint, pos int, title string, url string, date string", [(1, 1, "港口扩建工程今日正式开工建设", "http://www.people.com.cn/n1/2026/0803/c1.html", "2026-08-03"), (1, 2, "沿海城市迎来新的航线网络", "http://politics.people.com.cn/n1/2026/0804/c2.html", "2026-08-04")]))
def _(spark, folder):
    return embedded.news_links(Fixture("page_id bigint, html string, url string", [(1, NEWS_PAGE, "http://www.people.com.cn/")]).df(spark, folder))


SLOTS = Fixture("page_id bigint, html string", [
    (1, '<script id="js-initialData" type="text/json">{"initialState":{"entities":{"articles":{"9":{"title":"T","content":"<p>Body <b>text</b></p>","created":1785888000,"voteupCount":7}}}}}</script>'),
    (2, '<script id="js-initialData" type="text/json">broken</script><script id="__NEXT_DATA__" type="application/json">{"initialState":{"entities":{"articles":{"1":{"content":"x y","created":1785888000000,"voteupCount":1,"commentCount":2}}}}}</script>'),
    (3, "<script>window.__INITIAL_STATE__ = {\"a\": 1};</script>"), (4, "<p>plain</p>"),
])


@expected("state_articles", Fixture("page_id bigint, title string, meta string, body string, published string", [(1, "T", "知乎 · 7 赞 · ? 评论", "Body text", "2026-08-05"), (2, "", "知乎 · 1 赞 · 2 评论", "x y", "2026-08-05")]))
def _(spark, folder):
    return embedded.state_articles(SLOTS.df(spark, folder))


META_PAGES = Fixture("page_id bigint, url string, html string, title string, body_len bigint", [(1, "https://a.com/n1/2026/0807/c1.html", '<meta content="2018-05-01" name="date">', "Story", 2000), (2, "https://a.com/n1/2026/0807/c1.html", '<meta name="date" content="2026-08-01">', "Story", 2000), (3, "https://a.com/x", '<meta name="date" content="2018-05-01">', "Story", 2000)])


@expected("date_meta_any_order", Fixture("page_id bigint, date string, source string", [(1, "2018-05-01", "meta-generic"), (1, "2026-08-07", "url"), (2, "2026-08-01", "meta-generic"), (2, "2026-08-07", "url"), (3, "2018-05-01", "meta-generic")]))
def _(spark, folder):
    return pubdate.candidates(META_PAGES.df(spark, folder)).select("page_id", "date", "source")


@expected("date_meta_conflict", Fixture("page_id bigint, conflict double", [(1, 1.0), (2, 0.0), (3, 0.0)]))
def _(spark, folder):
    return pubdate.features(META_PAGES.df(spark, folder)).select("page_id", F.col("meta_url_conflict").alias("conflict"))


# --- evidence and reputation -----------------------------------------------------------------


@expected("bayes_readiness", Fixture("case string, samples bigint, good bigint, bad bigint, ready boolean", [("few", 39, 20, 19, False), ("one-sided", 60, 55, 5, False), ("enough", 40, 25, 15, True)]))
def _(spark, folder):
    parts = []
    for case, good, bad in (("few", 20, 19), ("one-sided", 55, 5), ("enough", 25, 15)):
        events = spark.range(good + bad + 5).select("id", F.when(F.col("id") < good, 0.9).when(F.col("id") < good + bad, 0.1).otherwise(0.5).alias("label"))
        parts.append(evidence.bayes_ready(events).withColumn("case", F.lit(case)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("case", "samples", "good", "bad", "ready")


@expected("bayes_gate", Fixture("token string", [("b",)]))
def _(spark, folder):
    model = spark.createDataFrame([("a",)], "token string")
    few = spark.range(10).select("id", F.lit(0.9).alias("label"))
    many = spark.range(60).select("id", F.when(F.col("id") < 30, 0.9).otherwise(0.1).alias("label"))
    return evidence.bayes_gated(model, few).unionByName(evidence.bayes_gated(model.select(F.lit("b").alias("token")), many))


@expected("bayes_training_gate", Fixture("id bigint", [(1,), (3,)]))
def _(spark, folder):
    return evidence.trainable(Fixture("id bigint, source string", [(1, "local-content-v1"), (2, "bayes-v1"), (3, "semantic-v1"), (4, None)]).df(spark, folder)).select("id")


SEEN = Fixture("id bigint, e double, p double, n double", [(1, 30.0, 5.0, 5.0), (2, 29.9, 9.0, 9.0), (3, 80.0, 4.0, 70.0), (4, None, None, None)])


@expected("prior_ready", Fixture("id bigint, ready boolean", [(1, True), (2, False), (3, False), (4, False)]))
def _(spark, folder):
    return SEEN.df(spark, folder).select("id", reputation.ready(F.col("e"), F.col("p"), F.col("n")).alias("ready"))


LOOKED = Fixture("id bigint, rep_score double, rep_samples bigint, rep_search_samples bigint, rep_content_samples bigint, prior double", [(1, None, None, None, None, 0.8), (2, 0.9, 5, 5, 0, 0.2), (3, 0.3, 10, 10, 0, 0.9), (4, 0.9, 1, 1, 0, None), (5, 0.2, 2, 1, 1, 0.6)])


@expected("rep_blend", Fixture("id bigint, score double, factor double, badge string", [(1, 0.8, 1.15, "[meta:0.80]"), (2, 0.69, 1.15, "[blend:0.69]"), (3, 0.3, 0.68, "⚠[rep:0.30]"), (4, 0.9, 1.0, ""), (5, 0.3984, 0.83744, "[blend:0.40]")]))
def _(spark, folder):
    return reputation.blended(LOOKED.df(spark, folder)).select("id", F.round("rep_score", 6).alias("score"), F.round("rep_factor", 6).alias("factor"), F.col("rep_badge").alias("badge"))


@expected("rep_low_discount", Fixture("id bigint, value double", [(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.5), (6, 0.3), (7, 0.3)]))
def _(spark, folder):
    rows = Fixture("key string, id bigint, at bigint, contribution double, low boolean", [("a", i, i, 0.5, i not in (1, 6)) for i in range(1, 8)])
    return reputation.discounted(rows.df(spark, folder)).select("id", F.round("value", 6).alias("value"))


@expected("rep_overview", Fixture("side string, place int, key string, score double", [("lowest", 1, "c", 0.1), ("lowest", 2, "a", 0.4), ("highest", 1, "b", 0.9), ("highest", 2, "d", 0.4)][:3] + [("highest", 2, "a", 0.4)]))
def _(spark, folder):
    return reputation.overview(Fixture("key string, score double", [("a", 0.4), ("b", 0.9), ("c", 0.1), ("d", 0.4)]).df(spark, folder), 2)


@expected("rep_top_weights", Fixture("token string, w double", [("x", -0.9), ("a", 0.5)]))
def _(spark, folder):
    return reputation.top_weights(Fixture("token string, w double", [("z", 0.5), ("a", 0.5), ("x", -0.9)]).df(spark, folder), 2)


@expected("rep_migration", Fixture("version bigint, key string, content_score double", [(4, "now", 0.7), (4, "old", 0.5)]))
def _(spark, folder):
    rows = Fixture("version bigint, key string, search_score double, search_samples bigint, fetch_samples bigint, content_score double, availability_score double", [(4, "now", 0.6, 3, 2, 0.7, 0.9), (3, "old", 0.6, 3, 0, 0.1, 0.1), (3, "mixed", 0.6, 3, 1, 0.1, 0.1), (2, "ancient", 0.6, 3, 0, 0.1, 0.1)])
    return reputation.migrated(rows.df(spark, folder)).select("version", "key", "content_score")


# --- results and plans -----------------------------------------------------------------------


@expected("redirects_resolved", Fixture("idx bigint, url string", [(0, "https://target.com/a"), (1, "https://plain.com/b"), (2, "https://s.com/link?x")]))
def _(spark, folder):
    rows = Fixture("idx bigint, url string", [(0, "https://s.com/link?url=1"), (1, "https://plain.com/b"), (2, "https://s.com/link?x")])
    known = Fixture("url string, target string", [("https://s.com/link?url=1", "https://target.com/a"), ("https://s.com/link?x", "")])
    return merge.resolved(rows.df(spark, folder), known.df(spark, folder)).select("idx", "url")


SHOWN = Fixture("query_id bigint, cluster_id bigint, label string, size bigint, tier string", [(1, 0, "甲", 3, "shown"), (1, 1, "乙", 2, "edge"), (1, 2, "丙", 2, "collapsed"), (1, 3, "丁", 1, "collapsed"), (2, 0, "戊", 2, "shown")])


@expected("tier_totals", Fixture("query_id bigint, tier string, clusters bigint, results bigint", [(1, "shown", 1, 3), (1, "edge", 1, 2), (1, "collapsed", 2, 3), (2, "shown", 1, 2)]))
def _(spark, folder):
    return grade.tier_totals(SHOWN.df(spark, folder))


@expected("clusters_markdown", Fixture("query_id bigint, markdown string", [(1, "## 甲 (3)\n## 乙 (2)\n> [丙]×2 · [丁]×1"), (2, "## 戊 (2)")]))
def _(spark, folder):
    return grade.markdown(SHOWN.df(spark, folder))


@expected("low_members", Fixture("query_id bigint, cluster_id bigint, size bigint, low bigint", [(1, 0, 3, 1), (1, 1, 1, 1)]))
def _(spark, folder):
    rows = Fixture("query_id bigint, cluster_id bigint, f string", [(1, 0, "low:spam-title"), (1, 0, "ad:domain"), (1, 0, ""), (1, 1, "low:shortener")]).df(spark, folder)
    return grade.low_members(rows.withColumn("flags", F.array("f")))


@expected("embed_threshold", Fixture("backend string, threshold double", [("api", 0.5), ("local", 0.55), ("named", 0.7)]))
def _(spark, folder):
    return spark.createDataFrame([("api", embed.threshold("api")), ("local", embed.threshold("local")), ("named", embed.threshold("api", 0.7))], "backend string, threshold double")


@expected("embed_hashed", Fixture("id bigint, dims int, norm double, same double", [(1, 64, 1.0, 1.0), (2, 64, 1.0, 1.0)]))
def _(spark, folder):
    rows = Fixture("id bigint, text string", [(1, "harbour tide tables"), (2, "tables TIDE harbour"), (3, "!")]).df(spark, folder)
    v = embed.hashed(rows, dimensions=64)
    one = v.where("id = 1").select(F.col("vec").alias("first"))
    both = v.join(F.broadcast(one))
    dot = lambda a, b: F.expr(f"round(aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (t, x) -> t + x), 6)")
    return both.select("id", F.size("vec").alias("dims"), dot("vec", "vec").alias("norm"), dot("vec", "first").alias("same"))


told(
    Fixture("id bigint, a string, b string", [(1, "harbour tides", "tides of the harbour"), (2, "大模型", "模型发布"), (3, "", "x1"), (4, "alpha", "beta")]),
    Fixture("id bigint, likeness double", [(1, 0.707107), (2, 0.408248), (3, None), (4, 0.0)]),
    "embed_likeness", ["id"], likeness=f"round({embed.likeness(SPARK, embed.tokens(SPARK, 'a'), embed.tokens(SPARK, 'b'))}, 6)",
)

FOUND = Fixture("query_id bigint, idx bigint, title string, url string, desc string, date string", [(1, 0, "Undated", "https://a.com/1", "No day is known of this one at all", None), (1, 1, "Later", "https://a.com/2", "Second day of the harbour fair", "2026-08-05"), (1, 2, "Earlier", "https://a.com/2026/0702/3.html", "First day", "2026-07-02"), (1, 3, "Beyond", "https://a.com/4", "x", None)])
EXTRACTS = Fixture("url string, markdown string, published string", [("https://a.com/2", "# Nav\n\nThe fair went on for another whole day.", "2026-08-06"), ("https://a.com/1", "", "")])
LINE = Fixture("query_id bigint, place int, month string, date string, title string, summary string", [(1, 1, "2026-07", "2026-07-02", "Earlier", "First day"), (1, 2, "2026-08", "2026-08-06", "Later", "The fair went on for another whole day."), (1, 3, None, None, "Undated", "No day is known of this one at all")])


@expected("timeline_cases", LINE)
def _(spark, folder):
    return search.timeline(FOUND.df(spark, folder), EXTRACTS.df(spark, folder), AS_OF, 1).select("query_id", "place", "month", "date", "title", "summary")


@expected("timeline_span", Fixture("query_id bigint, n bigint, months bigint, first string, last string", [(1, 2, 2, "2026-07-02", "2026-08-06")]))
def _(spark, folder):
    return search.spans(search.timeline(FOUND.df(spark, folder), EXTRACTS.df(spark, folder), AS_OF, 1))


# --- clusters --------------------------------------------------------------------------------

TITLED = Fixture("query_id bigint, idx bigint, title string, desc string, source_rank bigint, source_count bigint, quality double, rel double, query string", [
    (1, 0, "Harbour tides: tables for sailors", "", 1, 3, 1.0, 0.9, "harbour tides"), (1, 1, "New harbour tides tables", "", 2, 3, 0.8, 0.5, "harbour tides"), (1, 2, "Mountain weather for hikers", "", 3, 3, 1.0, -0.2, "harbour tides"),
    (1, 3, "Mountain weather map", "", 1, 1, 0.6, 0.1, "harbour tides"), (2, 0, "Unlike all else", "", 1, 1, 1.0, None, "unlike"),
])


@expected("cluster_phrase_cases", Fixture("query_id bigint, members string", [(1, "0|1"), (1, "0|2"), (1, "2|3")][:1] + [(1, "2|3")]))
def _(spark, folder):
    c = cluster.by_phrase(TITLED.df(spark, folder))
    return c.groupBy("query_id", "cluster_id").agg(F.array_join(F.sort_array(F.collect_list("idx")).cast("array<string>"), "|").alias("members")).select("query_id", "members")


MEMBERS = Fixture("query_id bigint, cluster_id int, idx bigint", [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (2, 0, 0)])


@expected("cluster_label_cases", Fixture("query_id bigint, cluster_id int, label string", [(1, 0, "arbour tides"), (1, 1, "Mountain weather"), (2, 0, "Unlike all else")]))
def _(spark, folder):
    return cluster.labels(MEMBERS.df(spark, folder), TITLED.df(spark, folder))


@expected("cluster_score_cases", Fixture("query_id bigint, cluster_id int, size bigint, quality double, rank_score double, text_score double, sem_score double, score double, low_relevance boolean", [(1, 0, 2, 0.9, 0.75, 1.0, 0.7, 0.782562, False), (1, 1, 2, 0.8, 0.5, 0.0, 0.05, 0.0945, True), (2, 0, 1, 1.0, 1.0, 1.0, None, 1.0, False)]))
def _(spark, folder):
    rows, members = TITLED.df(spark, folder), MEMBERS.df(spark, folder)
    s = cluster.scored(members, rows, cluster.text_scores(members, rows))
    return s.select("query_id", "cluster_id", "size", *(F.round(c, 6).alias(c) for c in ("quality", "rank_score", "text_score", "sem_score", "score")), "low_relevance")


OVERLAP = Fixture("query_id bigint, cluster_id int, idx bigint", [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2), (1, 2, 2)])
OVERLAP_SCORES = Fixture("query_id bigint, cluster_id int, score double, size bigint", [(1, 0, 0.4, 2), (1, 1, 0.9, 2), (1, 2, 0.9, 1)])


@expected("cluster_assign_cases", Fixture("query_id bigint, cluster_id int, idx bigint", [(1, 0, 0), (1, 1, 1), (1, 1, 2)]))
def _(spark, folder):
    return cluster.assigned(OVERLAP.df(spark, folder), OVERLAP_SCORES.df(spark, folder))


VECTORS = Fixture("query_id bigint, idx bigint, vec array<double>", [(1, 0, [1.0, 0.0, 0.0]), (1, 1, [0.6, 0.8, 0.0]), (1, 2, [0.0, 0.0, 1.0]), (1, 3, [0.99995, 0.01, 0.0]), (1, 4, [0.0, 0.1, 0.994987])])


@expected("cluster_semantic_cases", Fixture("query_id bigint, cluster_id int, idx bigint, role string, duplicate_of bigint", [(1, 0, 0, "item", None), (1, 0, 1, "item", None), (1, 1, 2, "item", None), (1, 0, 3, "item", None), (1, 1, 4, "duplicate", 2)]))
def _(spark, folder):
    rows = VECTORS.df(spark, folder).withColumn("tokens", F.array().cast("array<string>"))
    return cluster.by_vector(rows, sim=0.5, buckets=False)


REPRINTED = Fixture("query_id bigint, idx bigint, title string, desc string, vec array<double>", [(1, 0, "Harbour opens a second northern pier", "x", [1.0, 0.0]), (1, 1, "Harbour opens a second northern pier - Daily", "y", [0.8, 0.6]), (1, 2, "Harbour opens a second northern pier!", "z", [0.0, 1.0]), (1, 3, "Another title of no likeness", "the council decided on monday to widen the road", [0.8, 0.6]), (1, 4, "And yet another one altogether", "the council decided on monday to widen the roads", [0.0, 1.0]), (2, 0, "Harbour opens a second northern pier", "x", [0.8, 0.6])])


@expected("reprints", Fixture("query_id bigint, idx bigint, duplicate_of bigint", [(1, 1, 0)]))
def _(spark, folder):
    return cluster.reprints(REPRINTED.df(spark, folder))


COPIED = Fixture("query_id bigint, idx bigint, title string, stem string", [(1, 0, "港口扩建工程今日正式开工", "newsfarm"), (1, 1, "港口扩建工程昨日全面开工", "newsfarmtwo"), (1, 2, "港口扩建工程今日正式开工了", "elsewhere"), (1, 3, "天气预报说明天有雨", "newsfarm"), (2, 0, "港口扩建工程今日正式开工", "newsfarm")])


@expected("zh_dedupe_cases", Fixture("query_id bigint, idx bigint, duplicate_of bigint", [(1, 1, 0), (1, 2, 0)]))
def _(spark, folder):
    return cluster.farm_dedup(COPIED.df(spark, folder))


# --- learning and state ----------------------------------------------------------------------

PICKS = Fixture("page_id bigint, date string, source string", [(1, "2026-08-01", "url"), (2, "2026-08-01", "jsonld"), (3, "", "none"), (4, "2026-08-01", "url")])


@expected("date_outcomes", Fixture("page_id bigint, source string, right double", [(1, "url", 1.0), (2, "jsonld", 0.0)]))
def _(spark, folder):
    known = Fixture("page_id bigint, true_date string", [(1, "2026-08-02"), (2, "2026-07-01"), (3, "2026-08-01")])
    return pubdate.outcomes(PICKS.df(spark, folder), known.df(spark, folder)).select("page_id", "source", "right")


@expected("date_learning", Fixture("model string, feature string, weight double, moved double", [("m", "a", 0.05, 0.05), ("m", "bias", -0.00125, -0.10125)]))
def _(spark, folder):
    rows = Fixture("model string, at bigint, id string, label double", [("m", 1, "x", 1.0), ("m", 1, "x", 1.0), ("m", 2, "y", 0.0)]).df(spark, folder)
    ledger = rows.withColumn("features", F.when(F.col("id") == "x", F.create_map(F.lit("a"), F.lit(1.0))).otherwise(F.create_map(F.lit("a"), F.lit(0.0))))
    got = pubdate.inspected(pubdate.learned(ledger, {"a": 0.0}, 0.0, 0.1))
    return got.select("model", "feature", F.round("weight", 6).alias("weight"), F.round("moved", 6).alias("moved"))


@expected("ftrl_prior_cases", Fixture("model string, token string, w double", [("m", "t:bad", -0.164901), ("m", "t:good", 0.164901)]))
def _(spark, folder):
    rows = Fixture("model string, at bigint, id string, label double, confidence double, token string", [("m", 1, "a", 1.0, 1.0, "t:good"), ("m", 2, "b", 0.0, 1.0, "t:bad"), ("m", 2, "b", 0.0, 1.0, "t:bad"), ("m", 3, "c", 1.0, 1.0, "x:other")]).df(spark, folder)
    return reputation.fit_prior(rows.withColumn("tokens", F.array("token"))).select("model", "token", F.round("w", 6).alias("w"))


@expected("ttl_cache_cases", Fixture("id bigint, value string", [(1, None), (2, "a"), (3, "b"), (4, None), (5, None)]))
def _(spark, folder):
    asked = Fixture("id bigint, key string, at double", [(1, "k", 5.0), (2, "k", 10.0), (3, "k", 25.0), (4, "k", 40.0), (5, "other", 10.0)])
    saved = Fixture("key string, saved_at double, value string", [("k", 10.0, "a"), ("k", 20.0, "b")])
    return state.cached(asked.df(spark, folder), saved.df(spark, folder), 20.0).select("id", "value")
