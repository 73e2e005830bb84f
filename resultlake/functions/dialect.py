"""SQL expression builders in Spark's and DuckDB's dialect.

Scalar functions of this package build their expression from these, so that the same definition
runs inside whole-stage code on Spark and, for checking, on another engine.
"""

from __future__ import annotations

import re

#: Characters whose upper case is several (ŉ, ﬁ, ᾳ ...), and the single one that stands for each: its title case, if that is one.
_EXPANDING = "".join(c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1)
_SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _EXPANDING)


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, text: str) -> str:
        """A string literal without escapes."""
        if not self.spark:
            return "'" + text.replace("'", "''") + "'"
        if "'" not in text:
            return f"r'{text}'"
        return f'r"{text}"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def num(self, x: float) -> str:
        return f"{x}D" if self.spark else f"({x})::DOUBLE"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        if self.spark:
            return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)})"
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], to))}, 'g')"

    def ext(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def every(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def has(self, s: str, pattern: str) -> str:
        return f"{'regexp_like' if self.spark else 'regexp_matches'}({s}, {self.lit(pattern)})"

    def split(self, s: str, pattern: str) -> str:
        return f"{'split' if self.spark else 'string_split_regex'}({s}, {self.lit(pattern)})"

    def keep(self, xs: str, var: str, cond: str) -> str:
        return f"filter({xs}, {var} -> {cond})" if self.spark else f"list_filter({xs}, lambda {var}: {cond})"

    def each(self, xs: str, var: str, to: str) -> str:
        return f"transform({xs}, {var} -> {to})" if self.spark else f"list_transform({xs}, lambda {var}: {to})"

    def any(self, xs: str, var: str, cond: str) -> str:
        return f"exists({xs}, {var} -> {cond})" if self.spark else f"(len({self.keep(xs, var, cond)}) > 0)"

    def distinct(self, xs: str) -> str:
        """Distinct elements in ascending order."""
        return f"array_sort(array_distinct({xs}))" if self.spark else f"list_sort(list_distinct({xs}))"

    def size(self, xs: str) -> str:
        return f"CAST({'size' if self.spark else 'len'}({xs}) AS BIGINT)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def texts(self, xs) -> str:
        return self.array(*(self.lit(x) for x in xs))

    def chain(self, *xs: str) -> str:
        """Arrays one after the other."""
        out = xs[0]
        for x in xs[1:]:
            out = f"{'concat' if self.spark else 'list_concat'}({out}, {x})"
        return out

    def upto(self, n: str) -> str:
        """1..n; empty below 1."""
        return f"(CASE WHEN {n} >= 1 THEN sequence(1L, CAST({n} AS BIGINT)) ELSE array() END)" if self.spark else f"range(1, CAST({n} AS BIGINT) + 1)"

    def at(self, xs: str, i: str) -> str:
        """Element i from 1, null beyond."""
        return f"get({xs}, CAST({i} AS INT) - 1)" if self.spark else f"({xs})[CAST({i} AS BIGINT)]"

    def contains(self, xs: str, x: str) -> str:
        return f"{'array' if self.spark else 'list'}_contains({xs}, {x})"

    def join(self, xs: str, by: str) -> str:
        return f"{'array_join' if self.spark else 'array_to_string'}({xs}, {self.lit(by)})"

    def total(self, xs: str) -> str:
        """Sum of an array of doubles; 0 for none."""
        return f"aggregate({xs}, 0D, (t, x) -> t + x)" if self.spark else f"coalesce(list_sum({xs}), 0)::DOUBLE"

    def product(self, xs: str) -> str:
        return f"aggregate({xs}, 1D, (t, x) -> t * x)" if self.spark else f"coalesce(list_product({xs}), 1)::DOUBLE"

    def most(self, xs: str) -> str:
        return f"{'array' if self.spark else 'list'}_max({xs})"

    def from_hex(self, s: str) -> str:
        return f"CAST(conv({s}, 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || {s} AS BIGINT)"

    def char(self, code: str) -> str:
        """The character of a code point."""
        return f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')" if self.spark else f"chr(CAST({code} AS INTEGER))"

    def pair(self, text: str, code: str) -> str:
        return f"named_struct('text', {text}, 'code', {code})" if self.spark else f"{{'text': {text}, 'code': {code}}}"

    def fold(self, pairs: str, start: str, var: str, to) -> str:
        """A text changed by each pair in turn; ``to`` makes the next text of an expression for the last."""
        if self.spark:
            return f"aggregate({pairs}, {start}, (t, {var}) -> {to('t')})"
        made = lambda text: f"{{'text': {text}, 'code': 0::BIGINT}}"
        first = f"list_prepend({made(start)}, list_transform({pairs}, lambda q: {{'text': q.text, 'code': q.code::BIGINT}}))"
        return f"list_reduce({first}, lambda t, {var}: {made(to('t.text'))}).text"

    def let(self, value: str, var: str, body: str) -> str:
        """``body`` with ``var`` for ``value``, which is evaluated once."""
        return self.at(self.each(self.array(value), var, body), "1")

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})" if self.spark else f"date_diff('day', {earlier}, {later})"

    def day(self, y: str, m: str, d: str) -> str:
        """The date; days beyond the month's end run on."""
        return f"date_add(make_date(CAST({y} AS INT), CAST({m} AS INT), 1), CAST({d} AS INT) - 1)" if self.spark else f"CAST(make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), 1) + CAST(CAST({d} AS BIGINT) - 1 AS INTEGER) AS DATE)"

    def upper(self, s: str) -> str:
        """Upper case, one character for one, as SQL has it: Spark's own makes SS of ß."""
        if not self.spark:
            return f"upper({s})"
        aside = "".join(chr(0xE000 + i) for i in range(len(_EXPANDING)))
        return f"translate(upper(translate({s}, '{_EXPANDING}', '{aside}')), '{aside}', '{_SINGLE}')"

    def pad2(self, s: str) -> str:
        return f"lpad({s}, 2, '0')"


SPARK, DUCK = Dialect(True), Dialect(False)
CJK = r"[\x{4e00}-\x{9fff}]"
WHITE = r"[\s\x{00a0}\x{3000}\x{feff}]"
