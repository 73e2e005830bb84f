"""Results and articles that pages carry as data: result streams in scripts, news link lists, state slots."""

from __future__ import annotations

import bisect
import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, dates, text, urls
from ..functions.dialect import SPARK

# Fixed values that results depend on: field names, limits and words of the page formats.
STREAM_URL = re.compile(r'"ttsearch_msite_url":"(https://[^"]+)"')
STREAM_TITLE = re.compile(r'"(?:title|title_txt|abstract_title|show_title)":"((?:[^"\\]|\\.)*)"')
STREAM_TEXT = re.compile(r'"summary_text":"((?:[^"\\]|\\.)*)"')
STREAM_TIME = re.compile(r'"(?:publish_time|display_time)":"(\d{10})"')
STREAM_GROUP = re.compile(r"/group/(\d+)/")
AROUND = 5000
NAV = "(?i)登录|注册|首页|更多|关于我们|网站地图|English|微博|微信|客户端|邮箱|RSS|招聘|设为首页|加入收藏|版权所有|广告|举报|搜索|无障碍|简体|繁体|欢迎您|滚动|时政要闻|高层|人事|理论|党建|独家|视频|访谈|数字报|专题|图解|数据库|书刊|论坛"
NEWS_LEAST_TITLE, NEWS_MOST = 8, 400
#: Seconds below, milliseconds from here on.
MILLISECONDS = 1_000_000_000_000


def _unescaped(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"')
    except ValueError:
        return raw


def stream_results(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, url, desc, date, entries) of a result stream in page scripts.

    Every link takes the title field nearest to it within ``AROUND`` characters; a story counts
    once.  ``entries``: links there are in the page.
    """
    import pandas as pd

    def found(html: str):
        links = list(STREAM_URL.finditer(html))
        titles = [(m.start(), m[1]) for m in STREAM_TITLE.finditer(html)]
        starts = [at for at, _ in titles]
        met = set()
        for m in links:
            group = STREAM_GROUP.search(m[1])
            story = group[1] if group else m[1]
            if story in met:
                continue
            met.add(story)
            low, high = max(0, m.start() - AROUND), m.start() + AROUND
            near = titles[bisect.bisect_left(starts, low) : bisect.bisect_right(starts, high)]
            near = [(abs(at - m.start()), at, t) for at, raw in near if at + len(raw) < high and len(t := _unescaped(raw)) > 2]
            around = html[low:high]
            summary, stamp = STREAM_TEXT.search(around), STREAM_TIME.search(around)
            if near:
                yield min(near)[2], m[1], _unescaped(summary[1]) if summary else "", int(stamp[1]) if stamp else None, len(links)

    def run(frames):
        for f in frames:
            rows = [(i, k, *r) for i, html in zip(f["page_id"], f["html"], strict=True) for k, r in enumerate(found(html or ""))]
            out = pd.DataFrame(rows, columns=["page_id", "pos", "title", "url", "desc", "stamp", "entries"])
            out["stamp"] = out["stamp"].astype("Int64")
            yield out

    raw = pages.select("page_id", "html").mapInPandas(run, "page_id bigint, pos int, title string, url string, desc string, stamp bigint, entries int")
    title, desc = F.expr(text.clean(SPARK, "title")), F.expr(f"substr({text.clean(SPARK, '`desc`')}, 1, 400)")
    cleaned = raw.select("page_id", "pos", title.alias("title"), col(urls.scrubbed, "url").alias("url"), desc.alias("desc"), "stamp", "entries")
    day = F.coalesce(F.date_format(F.timestamp_seconds("stamp"), "yyyy-MM-dd"), F.expr(dates.absolute(SPARK, "concat(title, ' ', `desc`)")))
    return cleaned.select("page_id", "pos", "title", "url", "desc", day.alias("date"), "entries")


def news_links(pages: DataFrame, most: int = NEWS_MOST) -> DataFrame:
    """(page_id, pos, title, url, date): article links of news lists (page_id, html, url of the list)."""
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.expr(r"""regexp_extract_all(html, '(?is)<a[^>]*href=["\\x27][^"\\x27]+["\\x27][^>]*>.*?</a>', 0)""")).alias("pos", "a"))
    href, inner = F.expr(r"""regexp_extract(a, '(?is)href=["\\x27]([^"\\x27]+)', 1)"""), F.expr(r"regexp_extract(a, '(?is)^<a[^>]*>(.*?)</a>', 1)")
    own = each.withColumn("href", href).withColumn("inner", inner)
    own = own.withColumn("title", F.expr(text.clean(SPARK, "inner"))).withColumn("href", F.expr(text.decode_entities(SPARK, "href")))
    own = own.where((F.length("title") >= NEWS_LEAST_TITLE) & ~F.col("title").rlike(NAV))
    whole = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("base", r"^(?i)https?://[^/?#]+", 0), "href")).otherwise(F.col("href"))
    own = own.withColumn("url", whole).where("url rlike '^https?:'").withColumn("low", F.lower("url"))
    story = F.when(F.col("low").contains("people.com.cn"), F.col("low").rlike(r"people\.com\.cn/n\d+/")).when(F.col("low").contains("12371.cn"), F.col("low").rlike(r"12371\.cn/20\d{2}/")).otherwise(F.col("low").rlike(r"\.(?:htm|shtml)$"))
    first = own.where(story).withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))).where("nth = 1")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("place") <= most)
    day = F.expr(f"coalesce(nullif({dates.url_date(SPARK, 'url')}, ''), {dates.absolute(SPARK, 'title')})")
    return kept.select("page_id", F.col("place").alias("pos"), "title", "url", day.alias("date"))


def state_json(html: str = "html") -> str:
    """The first of a page's state slots that holds valid JSON; null for none."""
    slots = (r'<script id="js-initialData" type="text/json">([\\s\\S]*?)</script>', r'<script id="__NEXT_DATA__" type="application/json">([\\s\\S]*?)</script>', r"window[.]__INITIAL_STATE__\\s*=\\s*([{][\\s\\S]*?[}])\\s*;?\\s*</script>")
    each = (f"regexp_extract({html}, '{s}', 1)" for s in slots)
    return "coalesce(" + ", ".join(f"get_json_object({e}, '$')" for e in each) + ")"


def state_articles(pages: DataFrame) -> DataFrame:
    """(page_id, title, meta, body, published): the first article in a page's state slot.

    ``created`` below ``MILLISECONDS`` counts seconds; without one there is no date.
    """
    kind = "map<string, struct<title: string, content: string, created: bigint, voteupCount: bigint, commentCount: bigint>>"
    own = pages.withColumn("a", F.expr(f"get(map_values(from_json(get_json_object({state_json()}, '$.initialState.entities.articles'), '{kind}')), 0)")).where("a.content <> ''")
    told = lambda c: F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("?"))
    seconds = F.when(F.col("a.created") < MILLISECONDS, F.col("a.created")).otherwise(F.floor(F.col("a.created") / 1000))
    return own.select(
        "page_id", F.coalesce("a.title", F.lit("")).alias("title"), F.concat(F.lit("知乎 · "), told("voteupCount"), F.lit(" 赞 · "), told("commentCount"), F.lit(" 评论")).alias("meta"),
        F.expr(text.strip_tags(SPARK, "a.content")).alias("body"), F.when(F.col("a.created") != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).alias("published"),
    )
