"""A small document tree over the standard HTML parser, with simple selectors.

Selectors are ``tag.class#id[attr^='x']`` compounds separated by blanks (descendants) and commas
(alternatives).  Broken markup gives whatever tree can be made; nothing raises.
"""

from __future__ import annotations

import re
from functools import cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that an opening one of the key closes.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SILENT = {"script", "style"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def __iter__(self):
        """All elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c

    def text(self, silent=True) -> str:
        if silent and self.tag in SILENT:
            return ""
        return "".join(c if isinstance(c, str) else c.text(silent) for c in self.children)

    def attr(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def up(self, n: int):
        node = self
        for _ in range(n):
            node = node.parent or node
        return node

    def all(self, selector: str) -> list[Node]:
        ways = _compiled(selector)
        return [e for e in self if any(_matches(e, way) for way in ways)]

    def one(self, selector: str) -> Node | None:
        ways = _compiled(selector)
        return next((e for e in self if any(_matches(e, way) for way in ways)), None)


_PART = re.compile(r"""(?P<tag>^[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*$]?)=['"]?(?P<value>[^'"\]]*)['"]?)?\]""")


@cache
def _compiled(selector: str):
    return [[[m.groupdict() for m in _PART.finditer(step)] for step in way.split()] for way in selector.split(",")]


def _is(e: Node, step) -> bool:
    for p in step:
        if p["tag"] and e.tag != p["tag"] or p["id"] and e.attr("id") != p["id"] or p["cls"] and p["cls"] not in e.attr("class").split():
            return False
        if p["attr"]:
            if p["attr"] not in e.attrs:
                return False
            v, want = e.attr(p["attr"]), p["value"]
            if want is not None and not {"": v == want, "^": v.startswith(want), "$": v.endswith(want), "*": want in v}[p["op"] or ""]:
                return False
    return True


def _matches(e: Node, way) -> bool:
    if not _is(e, way[-1]):
        return False
    rest, node = way[:-1], e.parent
    while rest and node is not None:
        if _is(node, rest[-1]):
            rest = rest[:-1]
        node = node.parent
    return not rest


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#document")

    def handle_starttag(self, tag, attrs):
        while self.now.tag in CLOSES.get(tag, ()) and self.now.parent:
            self.now = self.now.parent
        node = Node(tag, attrs, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, attrs, self.now))

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # the standard parser may give up on broken declarations: keep what it has
        return b.root
    return b.root


_WIDE = "一-鿿　-〿＀-￯"


def clean(text: str) -> str:
    """Collapsed white space, none between wide characters, no soft hyphens."""
    text = re.sub(r"\s+", " ", text).replace("­", "")
    return re.sub(rf"([{_WIDE}])\s+(?=[{_WIDE}])", r"\1", text).strip()
