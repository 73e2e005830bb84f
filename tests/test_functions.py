"""Literal cases of scalar functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from resultlake.functions import col, dates, text, urls
from resultlake.functions.dialect import DUCK, SPARK
from resultlake.operators import filters, pages
from resultlake.plans import rendered

AS_OF = "2026-08-10"


def one(spark, build, value, *args, name="s"):
    return spark.createDataFrame([(value,)], f"{name} string").select(F.expr(build(SPARK, name, *args)).alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "host", "keys"), [
    ("https://www.cnblogs.com/harbour/p/1", "cnblogs.com", ["cnblogs.com", "cnblogs.com/harbour"]), ("https://zhuanlan.zhihu.com/p/1", "zhihu.com", ["zhihu.com", "zhihu.com/p"]), ("https://news.harbour.com.cn/a", "harbour.com.cn", ["harbour.com.cn", "harbour.com.cn/a"]),
    ("not a url", "", []), ("https://e.so.com/we?q=1", "", []), ("https://news.example.com/2026/08/story", "example.com", ["example.com"]), ("https://github.com/login", "github.com", ["github.com"]), ("https://www.zhihu.com/question/123", "zhihu.com", ["zhihu.com", "zhihu.com/question"]),
])
def test_hosts_and_keys(spark, url, host, keys):
    assert one(spark, urls.registrable, url) == host
    assert one(spark, urls.rep_keys, url) == keys


@pytest.mark.parametrize(("url", "key"), [("https://www.a.com/1", "a.com/1"), ("https://a.com/1/", "a.com/1"), ("http://m.a.com/x?utm_source=1&b=2&ref=3#top", "a.com/x?b=2"), ("https://a.com/x?reference=1&sourceId=2", "a.com/x"), ("nonsense", "nonsense"), ("https://c.com/", "c.com")])
def test_dedup_key(spark, url, key):
    assert one(spark, urls.dedup_key, url) == key


def test_redirect_target(spark):
    assert one(spark, urls.redirect_target, "https://cn.bing.com/ck/a?a=b&u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS8") == "https://example.com/"


@pytest.mark.parametrize(("url", "safe"), [("https://example.com/a", True), ("http://8.8.8.8/", True), ("http://u:p@a.com/", False), ("http://localhost/", False), ("http://10.1.1.1/", False), ("http://127.0.0.1:80/", False), ("http://169.254.1.1/", False), ("http://2130706433/", False), ("http://[::1]/", False), ("ftp://a.com/", False), ("x", False)])
def test_url_safety(spark, url, safe):
    assert (one(spark, urls.unsafe_reason, url) is None) == safe


@pytest.mark.parametrize(("value", "want"), [("2026年8月5日", "2026-08-05"), ("昨天 12:30", "昨天"), ("阅读量 1000", ""), ("3 小时前", "3小时前"), ("8月1日", "2026-08-01"), ("2026年13月1日", "")])
def test_serp_date(spark, value, want):
    assert one(spark, dates.serp_date, value, AS_OF) == want


@pytest.mark.parametrize(("value", "want"), [("2026-08-07", 3), ("2026-07-01", 40), (None, None), ("3小时前", None), ("2周前", 14), ("昨天", 1), ("2030-01-01", 0), ("2026-02-31", 160)])
def test_days_ago(spark, value, want):
    assert one(spark, dates.days_ago, value, AS_OF) == want


def test_url_date(spark):
    assert one(spark, dates.url_date, "http://a.com/n1/2026/0801/c1024-1.html") == "2026-08-01"
    assert one(spark, dates.url_date, "http://a.com/2026/8/7/x") == "2026-08-07"
    assert one(spark, dates.url_date, "http://a.com/2026/1399/x") == ""


@pytest.mark.parametrize(("html", "day"), [("<p>card 4302232727206639 x</p>", ""), ("<p>20661231123 x</p>", ""), ("4302232727206639 am 2026年8月7日10时", "2026-08-07"), ("id 20260807103000.", "2026-08-07"), ("20260807", "2026-08-07"), ("on 2026-08-07T08:00", "2026-08-07")])
def test_dates_within_numbers_are_none(spark, html, day):
    assert one(spark, pages.published_simple, html, "'https://a.com/'") == day


def test_since_days():
    assert [dates.since_days(s, AS_OF) for s in ("24h", "1w", "1m", "1y", "2026-08-01", "junk", "0d")] == [1, 7, 30, 365, 9, None, None]


@pytest.mark.parametrize(("q", "asks"), [(q, True) for q in ("港口扩建大事件", "突发暴雨", "环保条例最新进展", "本周要闻", "今日大事", "近期动态")] + [(q, False) for q in ("1927年大事件", "建党百年大事记", "历史大事件", "纪念改革开放40周年", "那年大事")])
def test_time_intent(spark, q, asks):
    assert one(spark, filters.time_intent, q) is asks


def test_text(spark):
    assert one(spark, text.clean, "<b>中 文</b> &amp; &lt;x&gt;<script>no</script>") == "中文 & <x>"
    assert one(spark, text.normalize_title, "A | B·c — D_e") == "abcde"
    assert one(spark, text.label_title, "苹果公司_百度百科") == "苹果公司"
    assert one(spark, text.grams, "黄 历", 2) == ["黄历"]
    assert one(spark, text.grams, "a", 4) == []
    assert one(spark, text.words_plain, "The Quick fox, the end") == ["end", "fox", "quick"]
    assert one(spark, text.strip_control, "a\x1b[31mb\x07c\td") == "abc\td"
    assert one(spark, text.first_paragraph, "# 标题\n\n![i](u)\nA [linked](u) paragraph of text\nmore") == "A linked paragraph of text"


def test_flags_and_quality(spark):
    rows = [(1, "【广告】夏日家电促销", "https://a.com/x/1.html", "描述" * 20, False), (2, "普通的标题", "https://www.doubleclick.net/ads/1", "描述" * 20, False), (3, "普通的标题", "https://x.com/redirect?url=https://evil.com", "描述" * 20, False), (4, "一则平实的标题", "https://b.com/a/1.html", "本页无广告,只有文章,请慢慢读完", False), (5, "今日动态 - 港口网", "https://www.harbour.example/newsf/", "", False), (6, "免费字体下载中心", "https://v.com/a/b/c", "立即下载字体包,马上注册领取礼物", False), (7, None, None, None, None)]
    got = {r.id: r for r in filters.annotate(spark.createDataFrame(rows, "id int, title string, url string, desc string, is_ad boolean")).collect()}
    assert got[1].flags[0] == "ad:title-marker" and got[2].flags[0] == "ad:domain" and got[3].flags[0] == "ad:redirect-url" and got[1].quality == 0
    assert "low:desc-marker" not in got[4].flags
    assert "low:index-page" in got[5].flags and got[5].quality < 0.6
    assert "low:spam-desc" in got[6].flags
    assert got[7].quality == pytest.approx(0.7 * 0.9)


@pytest.mark.parametrize(("html", "kind"), [("<title>Just a moment...</title>", "cloudflare-interstitial"), ("too many requests", "rate-limit"), ("您当前请求存在异常 40362", "login-wall"), ("fine", None), (None, None)])
def test_antibot(spark, html, kind):
    assert one(spark, pages.antibot, html) == kind


def test_not_found(spark):
    assert one(spark, pages.not_found, "<title>404: This page could not be found.</title>") is True
    assert one(spark, pages.not_found, "<title>All about the meaning of code 404 in web servers, explained at length</title>") is False


def test_column_helper(spark):
    assert spark.createDataFrame([("https://www.a.com/",)], "u string").select(col(urls.host, "u")).first()[0] == "www.a.com"


@pytest.mark.parametrize("value", ["straße", "ŉ ǰ ﬁn ﬅ և", "ΐ ᾳ ῼ ᾈ ὖ", "İı ÿ ǆ ß", "plain é", ""])
def test_upper_case_is_that_of_sql(spark, value):
    want = duckdb.connect().execute("SELECT upper(?)", [value]).fetchone()[0]
    assert one(spark, lambda d, s: d.upper(s), value) == want


def test_rendered_titles_are_those_of_sql(spark):
    own = "SELECT {} AS title FROM (SELECT 10 AS doc_id, 'großes Haus' AS text)"
    want = duckdb.connect().execute(own.format(rendered.title(DUCK))).fetchone()[0]
    assert spark.sql(own.format(rendered.title(SPARK))).first().title == want == "[视频] GROẞES （Haus）"
