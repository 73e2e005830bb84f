"""Stored pages that are rendered from ``documents``, read by every parser: what comes out must be what went in.

Ten documents make a page, in turn one of each engine's form.  The SQL of these queries states the
rows of the table in the parsers' columns and knows nothing of markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Dialect
from ..sources import serp, stored, tables
from ..staging import folder_of
from .catalog import query
from .rendered import day, forms

PAGE = 10


def _columns(d: Dialect) -> dict[str, str]:
    """What a document becomes: letters only, so that no number in it looks like a date."""
    letters = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ' '), ' +', ' '))" if d.spark else "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ' ', 'g'), ' +', ' ', 'g'))"
    number = "translate(CAST(doc_id AS STRING), '0123456789', 'abcdefghij')"
    return {
        "doc_id": "doc_id", "page": f"CAST(floor(doc_id / {PAGE}) AS BIGINT)", "name": number, "title": f"'Story ' || {number} || ' of ' || substr({letters}, 1, 20) || 'x'", "words": f"'What ' || {number} || ' says ' || trim(substr({letters}, 30, 60)) || 'y'",
        "url": "'https://site' || (doc_id % 13) || '.example/a/' || doc_id", "day": day(d, "doc_id"), "score": "doc_id * 37 % 50000",
    }


ROWS_SQL = f"WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY doc_id) AS INTEGER) AS pos FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _columns(DUCK).items())} FROM documents))"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _columns(SPARK).items()))


def _pages(rows: DataFrame, blocks: dict[str, str], whole: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, engine, html): a block a row, joined in order; ``whole``: what begins, parts and ends a page of an engine."""
    whole = whole or {}
    by_page = lambda of: F.expr(forms("page", *of))
    names = list(blocks)
    each = rows.select("page", "doc_id", by_page([f"'{n}'" for n in names]).alias("engine"), by_page(list(blocks.values())).alias("block"))
    pages = each.groupBy(F.col("page").alias("page_id"), "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "block"))), lambda b: b["block"]).alias("blocks"))
    part = lambda k: F.coalesce(*(F.when(F.col("engine") == n, F.lit(w[k])) for n, w in whole.items()), F.lit("")) if whole else F.lit("")
    return pages.select("page_id", "engine", F.concat(part(0), F.array_join("blocks", "\x00"), part(2)).alias("html"), part(1).alias("by")).select("page_id", "engine", F.replace("html", F.lit("\x00"), F.col("by")).alias("html"))


MONTHS = "CAST(CAST(substr(day, 6, 2) AS INT) AS STRING) || '月' || CAST(CAST(substr(day, 9, 2) AS INT) AS STRING) || '日'"
REDIRECT = "'https://cn.bing.com/ck/a?a=b&amp;u=a1' || translate(replace(base64(CAST(url AS BINARY)), '=', ''), '+/', '-_')"
LINKED = f"CASE WHEN doc_id % 3 = 0 THEN {REDIRECT} ELSE url END"
RESULTS = {
    "bing": f"'<li class=\"b_algo\"><h2><a href=\"' || {LINKED} || '\">' || title || '</a></h2><div class=\"b_caption\"><p>' || day || ' ' || words || '</p></div></li>'",
    "so360": f"'<li class=\"res-list\"><h3 class=\"res-title\"><a href=\"https://www.so.com/link?m=1\">' || title || '</a></h3><a data-mdurl=\"' || url || '\"></a><span class=\"res-list-summary\">' || words || '</span><span class=\"g-c-gray\">2026年' || {MONTHS} || '</span></li><li class=\"res-list\"><div class=\"lianmeng-ad\"></div><h3 class=\"res-title\"><a href=\"https://ad.example\">ad</a></h3></li>'",
    "sm": "'<div class=\"qk-card\"><a class=\"qk-link-wrapper\" href=\"' || url || '\"><div class=\"qk-title-text\">' || title || '</div></a><div class=\"qk-paragraph-text\">' || words || '</div></div><div class=\"qk-card\"><a class=\"qk-link-wrapper\" href=\"https://m.sm.cn/x\"><div>inner</div></a></div>'",
    "sogou": "'<div class=\"vrwrap\"><h3><a href=\"/link?url=' || doc_id || '\">' || title || '</a></h3><p class=\"star-wiki\">' || words || '</p></div><div class=\"vrwrap\"><h3><a href=\"https://promo.example/\">promoted</a></h3></div>'",
    "sogou-wechat": "'<li id=\"sogou_vr_' || doc_id || '\"><h3><a href=\"/link?url=' || doc_id || '\">' || title || '</a></h3><p class=\"txt-info\">' || words || '</p><span class=\"all-time-y2\">by ' || name || '</span><script>document.write(timeConvert(''' || (unix_timestamp(CAST(day AS TIMESTAMP)) + 43200) || '''))</script></li>'",
    "marginalia": "'<section class=\"card\"><h2 class=\"text-md\"><a href=\"' || url || '\">' || title || '</a></h2><p>' || words || '</p></section>'",
    "chinaso": "'<div class=\"search-list\"><div class=\"list\"><a href=\"' || url || '\">' || title || '</a><div class=\"desc\">' || words || '</div><span class=\"time\">' || day || '</span></div></div>'",
    "searx": "'<article class=\"result\"><h3><a href=\"' || url || '\">' || title || '</a></h3><p class=\"content\">' || words || '</p></article>'",
    "baidu": "'<div class=\"c-result result\" data-log=\"{''mu'':''' || url || '''}\"><a href=\"https://www.baidu.com/link?x\"><h3>' || title || '</h3></a><div class=\"c-abstract\">' || words || '</div></div>'",
}


def _of(engine: list[str], **told: str) -> str:
    """An expression by engine in SQL: ``told`` where named, else ``other``."""
    return forms("page", *(told.get(e.replace("-", "_"), told["other"]) for e in engine))


_E = list(RESULTS)


@query("parsed_results", f"{ROWS_SQL} SELECT page AS page_id, {forms('page', *(f"'{e}'" for e in _E))} AS engine, pos, title, {_of(_E, sogou="'https://www.sogou.com/link?url=' || doc_id", sogou_wechat="'https://weixin.sogou.com/link?url=' || doc_id", other='url')} AS url, {_of(_E, bing="day || ' ' || words", other='words')} AS desc_text, {_of(_E, bing='day', so360='day', sogou_wechat='day', chinaso='day', other='NULL')} AS date, {_of(_E, sogou_wechat="'by ' || name", other='NULL')} AS account FROM r")
def _(spark, folder):
    """Result pages of nine engines: redirects, ads, inner links and promotions among them."""
    return serp.parse(_pages(_rows(spark, folder), RESULTS)).select("page_id", "engine", "pos", "title", "url", F.col("desc").alias("desc_text"), "date", "account")


BOARDS = {
    "toutiao": "'{\"Title\":\"' || title || '\",\"Url\":\"' || url || '?x=1\",\"HotValue\":\"' || score || '\"}'",
    "baidu": "'{\"word\":\"' || title || '\",\"url\":\"' || url || '\",\"hotScore\":\"' || score || '\"}'",
    "douyin": "'<a href=\"/hot/' || doc_id || '\"><h3>' || title || '</h3></a><a href=\"/user/2\"><h3>no</h3></a>'",
    "github": "'<article class=\"Box-row\"><h2><a href=\"/o/' || name || '\">x</a></h2><span>' || score || ' stars today</span></article><article class=\"Box-row\"><h2><a href=\"/trending/x\">x</a></h2></article>'",
    "weibo": "'<tr><td class=\"td-01\">' || (doc_id % 10 + 1) || '</td><td><a href=\"/weibo?q=' || doc_id || '\">' || title || '</a><span>' || score || '</span></td></tr>'",
}
AROUND = {"toutiao": ('{"data":[', ",", "]}"), "baidu": ('{"data":{"cards":[{"content":[{"content":[', ",", "]}]}]}}"), "weibo": ("<table>", "", "</table>")}
_B = list(BOARDS)
_HEAT = "CASE WHEN score >= 10000 THEN printf('%.1f', score / 10000.0) || '万' WHEN score > 0 THEN CAST(score AS VARCHAR) ELSE '' END"


@query("parsed_boards", f"{ROWS_SQL} SELECT page AS page_id, {forms('page', *(f"'{e}'" for e in _B))} AS engine, pos AS rank, {_of(_B, github="'o/' || name", other='title')} AS name, {_of(_B, douyin="'https://www.douyin.com/hot/' || doc_id", github="'https://github.com/o/' || name", weibo="'https://s.weibo.com/weibo?q=' || doc_id", other='url')} AS url, {_of(_B, douyin="''", github='CAST(score AS VARCHAR)', other=_HEAT)} AS heat FROM r")
def _(spark, folder):
    """Hot lists and trending pages of five sites."""
    return serp.boards(_pages(_rows(spark, folder), BOARDS, AROUND)).select("page_id", "engine", F.col("pos").alias("rank"), "name", "url", "heat")


ITEMS = {
    "hn": "'{\"title\":\"' || title || '\",\"url\":\"' || url || '\",\"points\":' || score || ',\"author\":\"' || name || '\",\"created_at\":\"' || day || 'T00:00:00Z\"}'",
    "github": "'{\"full_name\":\"o/' || name || '\",\"html_url\":\"' || url || '\",\"description\":\"' || words || '\",\"updated_at\":\"' || day || 'T00:00:00Z\"}'",
    "wikipedia": "'{\"title\":\"' || title || '\",\"snippet\":\"<b>What</b>' || substr(words, 5) || '\",\"timestamp\":\"' || day || 'T00:00:00Z\"}'",
    "searx": "'{\"title\":\"' || title || '\",\"url\":\"' || url || '\",\"content\":\"' || words || '\",\"engine\":\"ddg\",\"publishedDate\":\"' || day || '\"}'",
    "chinaso": "'{\"title\":\"<em>' || title || '</em>\",\"url\":\"' || url || '\",\"snippet\":\"' || words || '\",\"date\":\"' || day || '\"}'",
}
HELD = {"hn": ('{"hits":[', ",", "]}"), "github": ('{"items":[', ",", "]}"), "wikipedia": ('{"query":{"search":[', ",", "]}}"), "searx": ('{"results":[', ",", "]}"), "chinaso": ('{"data":{"data":[', ",", "]}}")}
_J = list(ITEMS)


@query("parsed_json", f"{ROWS_SQL} SELECT page AS page_id, {forms('page', *(f"'{e}'" for e in _J))} AS engine, pos, {_of(_J, github="'o/' || name", other='title')} AS title, {_of(_J, wikipedia="'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_')", other='url')} AS url, {_of(_J, hn="score || ' points · ' || name", searx="words || ' [via ddg]'", other='words')} AS desc_text, day AS date FROM r")
def _(spark, folder):
    """Answers of five JSON interfaces."""
    return serp.parse_json(_pages(_rows(spark, folder), ITEMS, HELD)).select("page_id", "engine", "pos", "title", "url", F.col("desc").alias("desc_text"), "date")


_STRICT = "'{\"id\":' || doc_id || ',\"title\":\"' || title || '\",\"link\":\"' || url || '\",\"abstract\":\"' || words || '\"}'"
_LOOSE = "'{id: ' || doc_id || ', title: ''' || title || ''', \"link\": \"' || url || '\", /* more */ abstract: ''' || words || ''', gone: undefined, }'"
STREAMED = {"data": _STRICT, "state": _STRICT, "loose": _LOOSE, "pushed": _LOOSE}
SCRIPTS = {
    "data": ('<script type="application/json">{"props":{"list":[', ",", "]}}</script>"), "state": ('<script>window.__INITIAL_STATE__ = {"list":[', ",", ']};(function(){var s;})()</script>'),
    "loose": ("<script>var a = 1; // {not: this}\nconst page = {n: 0x0a, list: [", ",", "],}\n; if (a) { run({}); }</script>"), "pushed": ("<p>x</p><script>self.queue.push([1, {items: [", ",", "]}])</script>"),
}


@query("parsed_scripts", f"{ROWS_SQL} SELECT page AS page_id, pos, title, url, words AS desc_text FROM r")
def _(spark, folder):
    """Lists within page scripts, in four ways that pages write them."""
    return serp.url_stream(_pages(_rows(spark, folder), STREAMED, SCRIPTS), r"/a/\d+").select("page_id", "pos", "title", "url", F.col("desc").alias("desc_text"))


@query("parsed_links", f"{ROWS_SQL} SELECT page AS page_id, pos, title, CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://host' || page || '.example/dir/b/' || doc_id END AS href FROM r")
def _(spark, folder):
    """Links of pages, every other one relative to its page's address."""
    block = "'<li><a href=\"' || CASE WHEN doc_id % 2 = 0 THEN url ELSE 'b/' || doc_id END || '\">' || title || '</a></li>'"
    pages = _pages(_rows(spark, folder), {"list": block}).withColumn("url", F.concat(F.lit("https://host"), "page_id", F.lit(".example/dir/index.html")))
    return serp.anchors(pages).select("page_id", "pos", "title", "href")


# --- stored pages ----------------------------------------------------------------------------

_DAY = "date_add(DATE'2026-01-01', CAST(page_id % 40 AS INT))"


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The result pages of ``documents``, with address and day."""
    made = _pages(_rows(spark, folder), RESULTS)
    return made.selectExpr("page_id", "concat('https://', engine, '.example/', page_id) AS url", "html", "engine", f"{_DAY} AS day")


@query("stored_results", f"{ROWS_SQL} SELECT page AS page_id, engine, title FROM (SELECT *, {forms('page', *(f"'{e}'" for e in _E))} AS engine FROM r) WHERE engine IN ('bing', 'searx', 'marginalia') AND page % 40 BETWEEN 5 AND 25")
def _(spark, folder):
    """Pages are stored twice, the second time as a replay, and read by engine and time window."""
    at = folder_of(spark, "stored")
    pages = stored_pages(spark, folder)
    stored.replace(pages, at, "engine", "day")
    stored.replace(pages.where("page_id % 2 = 0"), at, "engine", "day")
    stored.replace(pages, at, "engine", "day")
    found = stored.pages(spark, at, ["bing", "searx", "marginalia"], "2026-01-06", "2026-01-26")
    return serp.parse(found).select("page_id", "engine", "title")


@query("sink_batches", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def _(spark, folder):
    """Documents are added in three batches, one of them twice, and counted by source."""
    at = folder_of(spark, "batches")
    docs = tables.table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    for k in (0, 1, 2, 1):
        stored.append_once(docs.where(F.col("doc_id") % 3 == k), at, f"b{k}")
    return spark.read.parquet(at).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
