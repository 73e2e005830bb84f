"""Page text: titles, bodies, list decisions, blocked and missing pages, fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.dialect import Dialect

CHROME_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe"]
LEAST_BODY = 100

# Fixed values that results depend on: patterns by class, in order.
ANTIBOT = [
    ("cloudflare-turnstile", r"cType:\s*\x27(non-interactive|managed|interactive)\x27"),
    ("cloudflare-interstitial", r"(?i)<title>Just a moment\.\.\.</title>|challenges\.cloudflare\.com/cdn-cgi/challenge-platform"),
    ("js-countdown", r"(?i)manually proceed|countdown|enable javascript|waiting for javascript"),
    ("rate-limit", r"(?i)too many requests|rate limit(ed|ing)?|请求过于频繁|访问过于频繁|稍后再试"),
    ("captcha", r"(?i)g-recaptcha|recaptcha|hcaptcha|geetest|challenges\.cloudflare\.com/turnstile"),
    ("blocked", r"(?i)access denied|forbidden|blocked|拒绝访问|禁止访问|已被拦截"),
    ("login-wall", r"40362|您当前请求存在异常|暂时限制本次访问|摇一摇"),
]
ANTIBOT_TEXT = r"(?i)403|40362|风控|验证码|antispider|access denied|access restricted|forbidden|captcha|restricted|暂时限制本次访问|请求存在异常|摇一摇|rate limit|请求过于频繁|访问过于频繁|拒绝访问|禁止访问|已被拦截|blocked"
LOADING = r"(?i)正在加载|页面加载中|内容加载中|加载中…|加载中\.\.\.|loading\.\.\.|数据加载|努力加载|加载失败"
MISSING_TITLE = r"(?i)not\s*found|could\s*not\s*be\s*found"
MISSING_SHORT = r"(?i)不存在|无法找到|未能找到|not\s*found|couldn\x27t\s*be\s*found"
MISSING_HEAD = r"(?i)this\s*page\s*(could\s*not\s*be\s*found|does\s*not\s*exist|was\s*not\s*found)|请求的页面(不存在|无法找到)|找不到该页|页面不存在|您访问的页面(不存在|已被删除)"


def title(d: Dialect, html: str) -> str:
    return text.clean(d, d.ext(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def description(d: Dialect, html: str) -> str:
    """The description in a page's meta elements; empty if it has none."""
    one, two = d.ext(html, r'(?i)<meta[^>]*name="description"[^>]*content="([^"]+)"', 1), d.ext(html, r'(?i)<meta[^>]*property="og:description"[^>]*content="([^"]+)"', 1)
    return text.clean(d, f"coalesce(nullif({one}, ''), {two})")


def without_chrome(d: Dialect, html: str) -> str:
    for tag in CHROME_TAGS:
        html = d.sub(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    return html


def body(d: Dialect, html: str) -> str:
    """Text of article or main, else of the body without page chrome; each of 100 characters at least."""
    bare = without_chrome(d, html)
    parts = [text.strip_tags(d, d.ext("b", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)) for tag in ("article", "main", "body")]
    return d.let(bare, "b", "CASE " + " ".join(f"WHEN length({p}) >= {LEAST_BODY} THEN {p}" for p in parts) + " ELSE '' END")


def antibot(d: Dialect, html: str) -> str:
    """Class of a challenge or refusal page by its first 20,000 characters; null for none."""
    return d.let(f"substr({html}, 1, 20000)", "s", "CASE " + " ".join(f"WHEN {d.has('s', p)} THEN '{k}'" for k, p in ANTIBOT) + " END")


def not_found(d: Dialect, html: str) -> str:
    t, head = d.ext("s", r"(?is)<title[^>]*>(.*?)</title>", 1), "substr(s, 1, 3000)"
    rules = f"({d.has(t, '404')} AND {d.has(t, MISSING_TITLE)}) OR ({t} <> '' AND length({t}) < 60 AND {d.has(t, '404')} AND {d.has(t, MISSING_SHORT)}) OR ({d.has(head, '404')} AND {d.has(head, MISSING_HEAD)})"
    return d.let(f"substr({html}, 1, 20000)", "s", rules)


def fetch_class(d: Dialect, markdown: str, is_list: str, n_list: str, html_bytes: str, extra: str, least: int = 200) -> str:
    """full, truncated, blocked or empty."""
    n = "length(r)"
    bare = d.has("r", r"[A-Za-z0-9\x{4e00}-\x{9fff}]$")
    case = f"""CASE WHEN {is_list} AND {n_list} >= 3 AND {n} >= 60 THEN 'full'
      WHEN {n} >= {least} AND {n} < 3000 AND {d.has('r', LOADING)} THEN 'truncated'
      WHEN {n} >= {least} AND {n} < 3000 AND {html_bytes} >= 10 * {n} AND {bare} THEN 'truncated'
      WHEN {n} >= {least} THEN 'full'
      WHEN {d.has(f"substr(concat(r, ' ', {extra}), 1, 500)", ANTIBOT_TEXT)} THEN 'blocked' ELSE 'empty' END"""
    return d.let(f"trim({markdown})", "r", case)


def is_list(d: Dialect, body_length: str, links: str, link_text: str) -> str:
    """List page: little body, three links or more, and their text outweighs it."""
    return f"({body_length} < 1200 AND {links} >= 3 AND ({body_length} < 220 OR {link_text} > 1.5 * {body_length}))"


# Fixed values that results depend on: outcomes that speak against a mirror or a connection.
MIRROR_STATUS = (401, 403, 407, 408, 425, 429, 451)
MIRROR_MESSAGE = "abort|timeout|timed out|fetch failed|network|econn|enet|ehost|enotfound|unreachable|socket|dns"
TLS_MESSAGE = "(?i)ECONNRESET|EPROTO|CERT_HAS_EXPIRED|DEPTH_ZERO|SELF_SIGNED|UNABLE_TO_VERIFY|ERR_SSL|TLS|HANDSHAKE|expired|self-signed|unable to verify"
READABLE = ("text/html", "text/plain", "text/markdown")


def cloudflare(d: Dialect, kind: str) -> str:
    """Whether a class of ``antibot`` is one of that family."""
    return f"coalesce({kind} LIKE 'cloudflare%', false)"


def mirror_fault(d: Dialect, status: str, message: str) -> str:
    """Whether a failure speaks against the mirror itself: by status if there is one, else by message."""
    listed = ", ".join(map(str, MIRROR_STATUS))
    return f"CASE WHEN coalesce({status}, 0) > 0 THEN {status} IN ({listed}) OR {status} >= 500 ELSE {d.has(f'lower(coalesce({message}, {d.lit("")}))', MIRROR_MESSAGE)} END"


def tls_fallback(d: Dialect, status: str, message: str) -> str:
    """Whether another handshake is worth a try: status 403, or without a status a message of that kind."""
    return f"CASE WHEN {status} IS NOT NULL THEN {status} = 403 ELSE {d.has(f'coalesce({message}, {d.lit("")})', TLS_MESSAGE)} END"


def readable_type(d: Dialect, content_type: str) -> str:
    return "(" + " OR ".join(f"contains({content_type}, '{t}')" for t in READABLE) + ")"


def published_simple(d: Dialect, html: str, url: str) -> str:
    """Date of the article's meta element, else of the URL, else the first of the text; empty for none."""
    stamp = d.ext(html, r'(?i)<meta[^>]*property=["\x27]article:published_time["\x27][^>]*content=["\x27]([^"\x27]+)["\x27]', 1)
    return f"coalesce(nullif({dates.absolute(d, stamp)}, ''), nullif({dates.url_date(d, url)}, ''), {dates.standing(d, html)})"


def scanned(pages: DataFrame) -> DataFrame:
    """Rows of a readable content type, with html_bytes, from (url, content_type, html)."""
    from ..functions.dialect import SPARK

    return pages.where(F.expr(readable_type(SPARK, "content_type"))).withColumn("html_bytes", F.octet_length("html").cast("bigint"))


def mirrors_cool(failures: DataFrame) -> DataFrame:
    """(url, cool): whether all of a URL's mirrors failed by their own fault, from (url, status, message)."""
    from ..functions.dialect import SPARK

    return failures.groupBy("url").agg(F.bool_and(F.expr(mirror_fault(SPARK, "status", "message"))).alias("cool"))


def archived(copies: DataFrame) -> DataFrame:
    """(url, mirror, body): of each URL the copy of the first mirror by ``nth`` that has a body."""
    have = copies.where("coalesce(body, '') <> ''").groupBy("url").agg(F.min_by(F.struct("mirror", "body"), "nth").alias("c"))
    return have.select("url", "c.mirror", "c.body")


def fetched_in_time(responses: DataFrame, budget_ms: int) -> DataFrame:
    """Responses that came within their budget; what is late is left out, not the rest with it."""
    return responses.where(F.col("elapsed_ms") <= budget_ms)


def cacheable(fetched: DataFrame) -> DataFrame:
    """Only whole pages are kept for later."""
    return fetched.where("kind = 'full'")
