"""Main content of pages by text density, as plain text and Markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from .dom import Node, clean, parse

CHROME = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "button", "select"}
BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "br"}
GOOD, POOR = re.compile("article|content|post|body|entry|main|text", re.I), re.compile("comment|sidebar|share|related|recommend|footer|nav|menu|promo|ad-|banner", re.I)
LEAST = 100


def _score(node: Node) -> float:
    """Paragraph text directly below counts, links and poor names count against it."""
    told = node.attr("class") + " " + node.attr("id")
    own = 25.0 * bool(GOOD.search(told)) - 25.0 * bool(POOR.search(told)) + {"article": 30.0, "main": 20.0}.get(node.tag, 0.0)
    paragraphs = [c for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "div", "section")]
    text = sum(min(len(t), 600) / 10 + 3 * (t.count(",") + t.count("，") + t.count("。") + t.count(".")) for p in paragraphs if p.tag in ("p", "pre", "blockquote") and len(t := clean(p.text())) >= 25)
    whole = len(clean(node.text())) or 1
    links = sum(len(clean(a.text())) for a in node.all("a")) / whole
    return (own + text) * (1 - min(1.0, links))


def _bare(node: Node) -> Node:
    node.children = [c if isinstance(c, str) else _bare(c) for c in node.children if isinstance(c, str) or c.tag not in CHROME and not (POOR.search(c.attr("class")) and not GOOD.search(c.attr("class")))]
    return node


def markdown(node: Node) -> str:
    def walk(n) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        inner = "".join(walk(c) for c in n.children)
        if re.fullmatch("h[1-6]", n.tag):
            return f"\n\n{'#' * int(n.tag[1])} {inner.strip()}\n\n"
        if n.tag == "a" and n.attr("href") and inner.strip():
            return f"[{inner.strip()}]({n.attr('href')})"
        if n.tag == "li":
            return f"\n- {inner.strip()}"
        if n.tag == "br":
            return "\n"
        return f"\n\n{inner.strip()}\n\n" if n.tag in BLOCKS else inner

    return re.sub(r"\n{3,}", "\n\n", walk(node)).strip()


def article(html: str | None) -> tuple[str, str, str]:
    """(title, body, markdown); empty body where no part of the page has 100 characters."""
    doc = parse(html)
    heading, named = doc.one("h1"), doc.one("title")
    og = doc.one("meta[property='og:title']")
    title = clean(og.attr("content") if og else (heading or named).text() if heading or named else "")
    best, most = None, 0.0
    body = _bare(doc)
    for n in body:
        if n.tag in ("article", "main", "section", "div", "td", "body"):
            s = _score(n)
            if s > most and len(clean(n.text())) >= LEAST:
                best, most = n, s
    return (title, clean(best.text()), markdown(best)) if best is not None else (title, "", "")


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, title, body, markdown) of pages (page_id, html)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *article(h)) for p, h in zip(pdf["page_id"], pdf["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["page_id", "title", "body", "markdown"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, title string, body string, markdown string")
