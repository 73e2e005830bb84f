"""Advertising flags, quality scores and the filters and orders that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions.dialect import CJK, SPARK, Dialect

# Fixed values that results depend on.
AD_DOMAINS = ["doubleclick.net", "googlesyndication.com", "googleadservices.com", "adservice.google.com", "adservice.google.cn", "adservice.google.co.uk", "amazon-adsystem.com", "taboola.com", "outbrain.com", "criteo.com", "criteo.net", "adroll.com", "rubiconproject.com", "pubmatic.com", "openx.net", "revcontent.com", "mgid.com", "propellerads.com", "popads.net", "bidvertiser.com", "exoclick.com"]
SHORTENERS = ["t.cn", "dwz.cn", "url.cn", "bit.ly", "goo.gl", "is.gd", "tinyurl.com", "suo.im", "sohu.com/short", "v.douyin.com"]
REDIRECT_PATH = r"(?i)(?:^|/)(?:redirect|goto|jump|out|outlink|fwd|click)(?:\.php|\.jsp|\.aspx|\.html)?(?:/|$|\?)"
TARGET_PARAMS = ["url", "u", "target", "to", "dest", "destination", "redirect", "jump", "goto", "link", "next", "rurl", "go"]
STRONG_MARK = r"(?i)【广告】|\[广告\]|\[Sponsor(ed)?\]|\[Ad\]|^Sponsor(ed)?[:： ]|^Ad[:： ]|Advertisement|^广告[：:]|广告(?:推广|推荐)?[：:]"
SPAM_ACTION = "立即|马上|点击|赶紧|速来|抓紧|错过|抢"
SPAM_GOAL = "下载|注册|领取|优惠|折扣|促销|免费|红包|返现|秒杀|限时|低价|特价|直销"
HISTORICAL = r"(?i)(19\d{2}|公元前|历史|当年|那年|纪念|周年|大事记|回忆|往事|古代|近代|民国|清朝|明朝|宋朝|唐朝|汉朝|三国|史记)"
TIME_INTENT = r"(?i)(本周|上周|本月|上月|最近|最新|今日|今天|昨日|昨天|近\s*\d+\s*(天|日|周)|突发|快讯|进展|要闻|大事件|大事|近日|近期|近况|今晨|刚刚|今日要闻|this\s*week|this\s*month|latest|breaking|fresh|new\s+release|recent|today)"
QUALITY_FACTORS = {"low:shortener": 0.85, "low:desc-marker": 0.85, "low:title": 0.7, "low:desc-empty": 0.9, "low:desc-short": 0.92, "low:shouty": 0.88, "low:allcaps": 0.85, "low:spam-title": 0.6, "low:spam-desc": 0.7, "low:long-url": 0.92, "low:many-params": 0.9, "low:index-page": 0.45}
STALE_DAYS = 60


def weak_mark(d: Dialect, s: str) -> str:
    """The advertising word, unless a negation stands before it."""
    return d.has(d.sub(s, "(无|没有|免|去除|去|拦截)广告", ""), "广告")


def index_page(d: Dialect, u: str, title: str, text: str) -> str:
    """Whether a result is a landing or channel page rather than an article."""
    bare = d.sub(f"lower({urls.path(d, u)})", "/+$")
    segment = d.ext(bare, "^/([^/]+)$", 1)
    channel = f"({segment} <> '' AND {d.has(urls.path(d, u), '/$')} AND NOT {d.has(segment, r'\.[a-z0-9]{2,5}$')} AND NOT {d.has(segment, r'\d{4,}')})"
    root = f"({bare} = '' OR {d.has(bare, r'^/?(?:index|default|home)(?:\.html?)?$')})"
    return f"({urls.host(d, u)} <> '' AND length(trim({text})) <= 10 AND length(trim({title})) < 24 AND ({root} OR {channel}))"


def ad_flags(d: Dialect, title: str, u: str, text: str, is_ad: str) -> dict[str, str]:
    h = urls.host(d, u)
    domain = d.any(d.texts(AD_DOMAINS), "a", f"{h} = a OR {h} LIKE concat('%.', a)")
    redirect = f"({d.has('lower(' + urls.path(d, u) + ')', REDIRECT_PATH)} AND {d.any(urls.params(d, u), 'p', d.contains(d.texts(TARGET_PARAMS), 'p'))})"
    return {"ad:serp-marker": f"coalesce({is_ad}, false)", "ad:title-marker": d.has(title, STRONG_MARK), "ad:desc-marker": d.has(text, STRONG_MARK), "ad:domain": domain, "ad:redirect-url": redirect}


def flags(d: Dialect, title: str, u: str, text: str, is_ad: str) -> str:
    """All flags of a result, in a fixed order."""
    ads = ad_flags(d, title, u, text, is_ad)
    jump = d.has(u, r"(?i)^https?://weixin\.sogou\.com/link\?")
    lows = {
        "low:shortener": d.contains(d.texts(SHORTENERS), urls.host(d, u)),
        "low:desc-marker": f"({weak_mark(d, text)} AND NOT ({' OR '.join(ads.values())}))",
        "low:title": f"length({title}) < 4",
        "low:desc-empty": f"length({text}) = 0",
        "low:desc-short": f"length({text}) BETWEEN 1 AND 14",
        "low:shouty": d.has(title, "[!！]{2,}"),
        "low:allcaps": d.has(title, r"""^[A-Z0-9][A-Z0-9\s.'"&,-]{7,}$""".replace("'", r"\x27")),
        "low:spam-title": f"({d.has(title, SPAM_ACTION)} AND {d.has(title, SPAM_GOAL)})",
        "low:spam-desc": f"({d.has(text, SPAM_ACTION)} AND {d.has(text, SPAM_GOAL)})",
        "low:long-url": f"(length({u}) > 240 AND NOT {jump})",
        "low:many-params": f"({d.size(urls.params(d, u))} >= 6 AND NOT {jump})",
        "low:index-page": index_page(d, u, title, text),
    }
    return d.keep(d.array(*(f"CASE WHEN {c} THEN '{f}' END" for f, c in (ads | lows).items())), "f", "f IS NOT NULL")


def quality(d: Dialect, flags_: str) -> str:
    """0 with an advertising flag, else the product of the flags' factors, 0.15 at least."""
    factor = "CASE f " + " ".join(f"WHEN '{k}' THEN {d.num(v)}" for k, v in QUALITY_FACTORS.items()) + f" ELSE {d.num(1.0)} END"
    return f"CASE WHEN {d.any(flags_, 'f', 'f LIKE ' + d.lit('ad:%'))} THEN {d.num(0.0)} ELSE greatest({d.num(0.15)}, {d.product(d.each(flags_, 'f', factor))}) END"


def time_intent(d: Dialect, q: str) -> str:
    return f"({d.has(q, TIME_INTENT)} AND NOT {d.has(q, HISTORICAL)})"


def is_cjk(d: Dialect, q: str) -> str:
    return d.has(q, CJK)


def annotate(results: DataFrame) -> DataFrame:
    """``results`` (title, url, desc, is_ad) with flags and quality."""
    filled = results.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "url", "desc")})
    flagged = filled.withColumn("flags", F.expr(flags(SPARK, "title", "url", "`desc`", "is_ad")))
    return flagged.withColumn("quality", F.expr(quality(SPARK, "flags")))


def split(annotated: DataFrame) -> DataFrame:
    """With ``part``: ad, flagged or clean; only advertising ever leaves the results."""
    ad = F.exists("flags", lambda f: f.startswith("ad:"))
    return annotated.withColumn("part", F.when(ad, "ad").when(F.size("flags") > 0, "flagged").otherwise("clean"))


def recency(results: DataFrame, as_of: str) -> DataFrame:
    """With ``stale_days`` and the new order ``place`` by query_id.

    Where the query asks for news, results older than STALE_DAYS sink, oldest last.
    """
    ago = F.expr(dates.days_ago(SPARK, "date", as_of))
    stale = F.when(F.expr(time_intent(SPARK, "query")) & (ago > STALE_DAYS), ago)
    order = Window.partitionBy("query_id").orderBy(F.col("stale_days").isNotNull(), F.coalesce("stale_days", F.lit(0)), "idx")
    return results.withColumn("stale_days", stale).withColumn("place", F.row_number().over(order))


def since(results: DataFrame, window: str, as_of: str) -> DataFrame:
    """Without dated results older than a window (``24h``, ``1w``, a day); undated ones stay."""
    days = dates.since_days(window, as_of)
    if days is None:
        return results
    return results.where(F.expr(f"coalesce({dates.days_ago(SPARK, 'date', as_of)} <= {days}, true)"))
