"""Result pages of search sources as rows: one table of rules, one tree walk.

A source is described by the selectors of its blocks and fields; adding one is adding a rule.
``parse`` turns stored pages into rows, ``anchors`` gives the raw links that the source-agnostic
fallback (``operators.links``) works on relationally.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime
import json
import re
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import loose
from .dom import Node, clean, parse as tree

RESULT = "title string, url string, desc string, date string, account string"
BLOCKED = re.compile(r"安全验证|请输入验证码|验证码|captcha|antispider", re.I)


@dataclasses.dataclass(frozen=True)
class Rule:
    """Selectors of a source; ``real``: (selector, attribute) of the target behind a redirect."""

    block: str
    title: str
    desc: tuple[str, ...] = ()
    date: str = ""
    account: str = ""
    real: tuple[str, str] | None = None
    drop: str = ""  # pattern in a block's markup that marks advertising
    internal: tuple[str, ...] = ()  # hosts whose links aren't results
    base: str = ""  # what site-relative links continue
    fallback: str = ""  # plain links, where no block matches


RULES = {
    "bing": Rule("li.b_algo", "h2 a[href]", (".b_caption p", "p"), fallback="h2 a[href]"),
    "so360": Rule("li.res-list", "h3.res-title a[href]", ("span.res-list-summary", "div.res-rich"), ".g-c-gray", real=("a[data-mdurl]", "data-mdurl"), drop="lianmeng-ad", internal=("so.com", "360.cn")),
    "sm": Rule("div.qk-card", "a.qk-link-wrapper[href]", (".qk-paragraph-text",), drop="adclick|广告", internal=("sm.cn",)),
    "sogou": Rule("div.vrwrap", "h3 a[href^='/link?url=']", ("p.star-wiki", "div.text-layout", "p"), base="https://www.sogou.com"),
    "sogou-wechat": Rule("li[id^='sogou_vr_']", "h3 a[href]", ("p.txt-info",), account="span.all-time-y2", base="https://weixin.sogou.com"),
    "marginalia": Rule("section.card", "h2 a[href]", ("p",), fallback="a.title, h2 a[href]"),
    "chinaso": Rule(".search-list .list", "a[href]", (".desc", "p"), ".time"),
    "searx": Rule("article.result", "h3 a[href]", ("p.content",)),
    "baidu": Rule("div.c-result.result", "a[href], h3", (".c-abstract", "p"), internal=("baidu.com",)),
}


def redirect_target(href: str) -> str:
    """Target in parameter ``u`` (a1 and URL-safe base64), else the link itself."""
    code = (parse_qs(urlsplit(href).query).get("u") or [""])[0]
    if code.startswith("a1"):
        try:
            return base64.urlsafe_b64decode(code[2:] + "=" * (-len(code[2:]) % 4)).decode()
        except ValueError:
            return href
    return href


def serp_day(text: str) -> str:
    m = re.search(r"(20\d{2})[年/.-]?(\d{1,2})[月/.-]?(\d{1,2})", text)
    return f"{m[1]}-{int(m[2]):02}-{int(m[3]):02}" if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 else ""


def _markup(node: Node) -> str:
    return " ".join(f"{e.tag} {' '.join(f'{k}={v}' for k, v in e.attrs.items())}" for e in node) + " " + " ".join(node.attrs.values()) + node.text()


def results(html: str | None, engine: str, limit: int = 150) -> list[tuple]:
    """Rows (title, url, desc, date, account) of a stored page; none for a challenge page."""
    rule = RULES[engine]
    if not html or BLOCKED.search(html[:2000]):
        return []
    doc, rows = tree(html), []
    for block in doc.all(rule.block):
        link = block.one(rule.title)
        if link is None or rule.drop and re.search(rule.drop, _markup(block), re.I):
            continue
        title, href = clean(link.text()), link.attr("href")
        if engine == "baidu":
            mu = re.search(r"""["']mu["']\s*:\s*["']([^"']+)""", block.attr("data-log"))
            heading = block.one("h3")
            title, href = clean((heading or link).text()), mu[1] if mu else href
        if rule.real and (real := block.one(rule.real[0])) is not None and real.attr(rule.real[1]).startswith("http"):
            href = real.attr(rule.real[1])
        href = redirect_target(urljoin(rule.base, href) if rule.base else href)
        host = urlsplit(href).netloc.lower()
        own = any(host == h or host.endswith("." + h) for h in rule.internal) and "/link?" not in href
        if not title or not href.startswith("http") or own:
            continue
        desc = next((d for s in rule.desc if (n := block.one(s)) is not None and (d := clean(n.text()))), "")[:400]
        dated = block.one(rule.date) if rule.date else None
        stamp = re.search(r"timeConvert\('(\d+)'\)", block.text(silent=False))
        date = datetime.datetime.fromtimestamp(int(stamp[1]), datetime.UTC).date().isoformat() if stamp else serp_day(dated.text() if dated else "") or serp_day(f"{title} {desc}")
        named = block.one(rule.account) if rule.account else None
        rows.append((title, href, desc, date or None, clean(named.text()) if named else None))
        if len(rows) == limit:
            break
    if not rows and rule.fallback:
        for a in doc.all(rule.fallback):
            href = redirect_target(a.attr("href"))
            if clean(a.text()) and href.startswith("http"):
                rows.append((clean(a.text()), href, "", None, None))
    return rows[:limit]


def _exploded(pages: DataFrame, one, kinds: str) -> DataFrame:
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, e, k, *r) for p, e, h in zip(pdf["page_id"], pdf["engine"], pdf["html"], strict=True) for k, r in enumerate(one(h, e), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "engine", "pos", *names])

    engine = F.col("engine") if "engine" in pages.columns else F.lit("").alias("engine")
    return pages.select("page_id", engine, "html").mapInPandas(run, f"page_id bigint, engine string, pos int, {kinds}")


def parse(pages: DataFrame, limit: int = 150) -> DataFrame:
    """(page_id, engine, pos, title, url, desc, date, account) of pages (page_id, engine, html)."""
    return _exploded(pages, lambda h, e: results(h, e, limit), RESULT)


def _continued(base: str, href: str) -> str:
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def page_anchors(html: str | None, base: str = "") -> list[tuple]:
    rows = []
    for a in tree(html).all("a[href]"):
        above = [a.up(k) for k in range(1, 6)]
        nav = any(n.tag in ("nav", "header", "footer", "aside") or re.search(r"(?:^|[ _-])(nav|navbar|menu|breadcrumb|pagination|toolbar|topbar|footer|header|sidebar|category|channel|crumbs)(?:[ _-]|$)", n.attr("class"), re.I) for n in above)
        title = clean(a.text())
        around = a.up(2)
        time = around.one("time[datetime]")
        rows.append((_continued(base, a.attr("href")), title, clean(a.up(1).text().replace(a.text(), ""))[:300], ">".join(a.up(k).tag.upper() for k in range(3)), nav, serp_day(time.attr("datetime") if time else around.text()[:60])))
    return rows


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, engine, pos, href, title, desc, sig, nav, near_date) of all links of stored pages.

    With a column ``url`` relative links continue it.
    """
    if "url" in pages.columns:
        pages = pages.drop("engine").withColumn("engine", F.coalesce("url", F.lit("")))
        found = _exploded(pages, lambda h, e: page_anchors(h, e), "href string, title string, desc string, sig string, nav boolean, near_date string")
        return found.withColumn("engine", F.lit(""))
    return _exploded(pages, lambda h, e: page_anchors(h), "href string, title string, desc string, sig string, nav boolean, near_date string")


# --- boards ----------------------------------------------------------------------------------

BOARD = "rank int, name string, url string, heat string"


def _ten_thousands(n) -> str:
    n = float(n or 0)
    return f"{n / 10_000:.1f}万" if n >= 10_000 else str(int(n)) if n else ""


def board(body: str | None, kind: str) -> list[tuple]:
    """Rows (rank, name, url, heat) of a stored hot list or trending page; none if it can't be read."""
    try:
        if kind == "toutiao":
            return [(i, r.get("Title"), (r.get("Url") or f"https://www.toutiao.com/trending/{r.get('ClusterIdStr')}/").split("?")[0], _ten_thousands(r.get("HotValue"))) for i, r in enumerate(json.loads(body)["data"], 1) if r.get("Title")]
        if kind == "baidu":
            return [(i, r.get("word") or r.get("query"), r.get("url"), _ten_thousands(r.get("hotScore"))) for i, r in enumerate(json.loads(body)["data"]["cards"][0]["content"][0]["content"], 1)]
    except (ValueError, KeyError, IndexError, TypeError):
        return []
    doc = tree(body)
    if kind == "weibo":
        rows = []
        for tr in doc.all("tr"):
            a, rank, heat = tr.one("td a[href]"), tr.one("td.ranktop, td.td-01"), tr.one("td span")
            if a is None or not clean(a.text()) or "javascript" in a.attr("href"):
                continue
            n = clean(rank.text()) if rank else ""
            rows.append((int(n) if n.isdigit() else 0, clean(a.text()), urljoin("https://s.weibo.com", a.attr("href")), _ten_thousands("".join(re.findall(r"\d", heat.text()))) if heat else ""))
        return rows
    if kind == "douyin":
        return [(i, clean((a.one("h3") or a).text()), urljoin("https://www.douyin.com", a.attr("href")), "") for i, a in enumerate((x for x in doc.all("a[href^='/hot/']") if x.one("h3") is not None), 1)]
    if kind == "github":
        rows = []
        for b in doc.all("article.Box-row"):
            a = b.one("h2 a[href]")
            name = a.attr("href").strip("/") if a else ""
            if re.fullmatch(r"[^/]+/[^/]+", name) and not name.startswith("trending/"):
                delta = re.search(r"([\d,]+)\s*stars?\s+(?:today|this week|this month)", b.text())
                rows.append((len(rows) + 1, name, f"https://github.com/{name}", delta[1] if delta else ""))
        return rows
    return []


def boards(stored: DataFrame, limit: int = 50) -> DataFrame:
    """(page_id, engine, pos, rank, name, url, heat) of stored boards (page_id, engine, html)."""
    return _exploded(stored, lambda h, e: board(h, e)[:limit], BOARD)


def json_items(body: str | None, engine: str) -> list[tuple]:
    """Rows of the JSON interfaces of hn, github, wikipedia, searx and chinaso."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return []
    if engine == "hn":
        return [(h.get("title") or h.get("story_title") or "", h.get("url") or f"https://news.ycombinator.com/item?id={h.get('objectID')}", " · ".join(str(x) for x in (f"{h.get('points') or 0} points", h.get("author") or "")), (h.get("created_at") or "")[:10] or None, None) for h in data.get("hits", [])]
    if engine == "github":
        return [(r["full_name"], r["html_url"], (d[:512] + "…" if len(d := r.get("description") or "") > 512 else d), (r.get("updated_at") or "")[:10] or None, None) for r in data.get("items", [])]
    if engine == "wikipedia":
        from urllib.parse import quote

        return [(r["title"], "https://en.wikipedia.org/wiki/" + quote(r["title"].replace(" ", "_")), clean(tree(r.get("snippet")).text()), (r.get("timestamp") or "")[:10] or None, None) for r in data.get("query", {}).get("search", [])]
    if engine == "searx":
        return [(r["title"], r["url"], f"{(r.get('content') or '')[:200]} [via {r.get('engine')}]", serp_day(r.get("publishedDate") or "") or None, None) for r in data.get("results", [])]
    if engine == "chinaso":
        return [(clean(tree(r.get("title")).text()), r.get("url"), clean(tree(r.get("snippet")).text()), serp_day(str(r.get("date") or "")) or None, None) for r in (data.get("data") or {}).get("data", [])]
    return []


def parse_json(stored: DataFrame, limit: int = 150) -> DataFrame:
    return _exploded(stored, lambda h, e: json_items(h, e)[:limit], RESULT)


# --- embedded JSON ---------------------------------------------------------------------------


def json_blocks(html: str | None) -> list:
    """Values of script elements: JSON ones, and what others assign or pass as literals (``loose``)."""
    found = []
    for script in tree(html).all("script"):
        found += loose.literals(script.text(silent=False).strip())
    return found


def walk(value, shape: re.Pattern, limit: int) -> list[tuple]:
    """(title, url, desc) of objects that hold a URL of the shape; longest fitting strings win."""
    rows, seen = [], set()

    def visit(v):
        if isinstance(v, dict):
            texts = {k: s for k, s in v.items() if isinstance(s, str)}
            url = next((s for s in texts.values() if shape.search(s)), None)
            key = re.sub(r"^https?://(m\.)?|\?.*$", "", url or "")
            if url and key not in seen:
                told = lambda k, s: len(s) + 100 * bool(re.search("title|name|headline", k, re.I)) - 60 * (len(s) > 120) - 80 * bool(re.fullmatch(r"[\w-]{1,12}", s))
                others = sorted(((told(k, s), s) for k, s in texts.items() if not s.startswith("http")), reverse=True)
                if others:
                    seen.add(key)
                    desc = next((s for k, s in texts.items() if re.search("desc|abstract|summary|content", k, re.I)), others[1][1] if len(others) > 1 else "")
                    rows.append((others[0][1], url, desc))
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            visit(x)

    visit(value)
    return rows[:limit]


def url_stream(pages: DataFrame, shape: str, limit: int = 50) -> DataFrame:
    """(page_id, engine, pos, title, url, desc) from any embedded JSON."""
    return _exploded(pages, lambda h, e: [r for b in json_blocks(h) for r in walk(b, re.compile(shape), limit)][:limit], "title string, url string, desc string")
