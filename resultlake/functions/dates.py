"""Date functions over result texts and URLs; the present day is always a parameter."""

from __future__ import annotations

from .dialect import Dialect

_SEP = r"[年/.-]?(\d{1,2})[月/.-]?(\d{1,2})[日]?"


def _valid(d: Dialect, m: str, day: str) -> str:
    """Month and day that exist, February having 29."""
    m, day = f"CAST({m} AS INT)", f"CAST({day} AS INT)"
    return f"({m} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND (CASE WHEN {m} = 2 THEN 29 WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END))"


def _iso(d: Dialect, s: str, pattern: str) -> str:
    y, m, day = (d.ext(s, pattern, k) for k in (1, 2, 3))
    return f"CASE WHEN {y} = '' THEN '' WHEN {_valid(d, m, day)} THEN concat({y}, '-', {d.pad2(m)}, '-', {d.pad2(day)}) ELSE '' END"


def url_date(d: Dialect, u: str) -> str:
    """Date of /20YY/MMDD/ or else of 20YY/M/D in a URL; empty if there is none."""
    first, second = _iso(d, u, r"/(20\d{2})/(\d{2})(\d{2})/"), _iso(d, u, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})[^0-9]")
    return f"coalesce(nullif({first}, ''), {second})"


def absolute(d: Dialect, s: str) -> str:
    """The first full date of a text as YYYY-MM-DD; empty if there is none."""
    return _iso(d, s, r"(20\d{2})" + _SEP)


def standing(d: Dialect, s: str) -> str:
    """As ``absolute``, of dates that stand alone: a run of other digits around them is a number, a time of day may follow."""
    return _iso(d, s, r"(?:^|[^0-9])(20\d{2})" + _SEP + r"(?:(?:[01]\d|2[0-3])[0-5]\d[0-5]\d)?(?:[^0-9]|$)")


def serp_date(d: Dialect, s: str, as_of: str) -> str:
    """Relative date text in its short form, else the absolute date; ``as_of`` gives a missing year."""
    parts = [(r"(\d+)\s*(分钟|小时)\s*前", f"concat({d.ext(s, r'(\d+)\s*(分钟|小时)\s*前', 1)}, {d.ext(s, r'(\d+)\s*(分钟|小时)\s*前', 2)}, '前')"), ("昨天|昨日", "'昨天'"), ("前天", "'前天'")]
    for pattern, unit in ((r"(\d+)\s*(?:天|日)\s*前", "天前"), (r"(\d+)\s*周\s*前", "周前"), (r"(\d+)\s*个?月\s*前", "个月前"), (r"(\d+)\s*年\s*前", "年前")):
        parts.append((pattern, f"concat({d.ext(s, pattern, 1)}, '{unit}')"))
    whens = " ".join(f"WHEN {d.has(s, p)} THEN {out}" for p, out in parts)
    md = r"(\d{1,2})月(\d{1,2})日"
    m, day = d.ext(s, md, 1), d.ext(s, md, 2)
    year = f"'{as_of[:4]}'"
    return f"CASE {whens} WHEN {absolute(d, s)} <> '' THEN {absolute(d, s)} WHEN {m} <> '' THEN CASE WHEN {_valid(d, m, day)} THEN concat({year}, '-', {d.pad2(m)}, '-', {d.pad2(day)}) ELSE '' END ELSE '' END"


def days_ago(d: Dialect, s: str, as_of: str) -> str:
    """Days before ``as_of`` that a date text names; null if it names none, 0 for the future."""
    number = lambda p: f"CAST({d.ext(s, p, 1)} AS BIGINT)"
    whens = " ".join(f"WHEN {d.has(s, p)} THEN {number(p)} * {k}" for p, k in ((r"(\d+)\s*(?:天|日)\s*前", 1), (r"(\d+)\s*周\s*前", 7), (r"(\d+)\s*个?月\s*前", 30), (r"(\d+)\s*年\s*前", 365)))
    full, md = r"(\d{4})" + _SEP, r"(\d{1,2})月(\d{1,2})日"
    today = f"CAST('{as_of}' AS DATE)"
    part = lambda p, k: f"coalesce(nullif({d.ext(s, p, k)}, ''), '1')"
    one = d.day(part(full, 1), f"least(greatest(CAST({part(full, 2)} AS INT), 1), 12)", part(full, 3))
    two = d.day(f"'{as_of[:4]}'", f"least(greatest(CAST({part(md, 1)} AS INT), 1), 12)", part(md, 2))
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' THEN NULL {whens} WHEN {d.has(s, '昨天|昨日')} THEN 1 WHEN {d.has(s, '前天')} THEN 2 WHEN {d.has(s, '上周')} THEN 7 "
        f"WHEN {d.has(s, full)} THEN greatest(0, CAST({d.days(today, one)} AS BIGINT)) WHEN {d.has(s, md)} THEN greatest(0, CAST({d.days(today, two)} AS BIGINT)) END"
    )


def absolute_of(d: Dialect, s: str, as_of: str) -> str:
    """Any date text as YYYY-MM-DD by ``as_of``; empty if it names no day."""
    ago = days_ago(d, s, as_of)
    today = f"CAST('{as_of}' AS DATE)"
    back = f"CAST(date_sub({today}, CAST({ago} AS INT)) AS STRING)" if d.spark else f"CAST(CAST({today} - CAST({ago} AS INTEGER) AS DATE) AS VARCHAR)"
    return f"CASE WHEN {absolute(d, s)} <> '' THEN {absolute(d, s)} WHEN {ago} IS NOT NULL THEN {back} ELSE '' END"


def since_days(since: str, as_of: str) -> int | None:
    """Days of a window such as 24h, 1w, 3m, 1y or since a day; None if it can't be read."""
    import datetime
    import re

    if m := re.fullmatch(r"(\d+)([hdwmy])", since.strip(), re.I):
        n = int(m[1]) * {"h": 1 / 24, "d": 1, "w": 7, "m": 30, "y": 365}[m[2].lower()]
        return max(1, int(n + 0.5)) if n > 0 else None
    try:
        return max(1, (datetime.date.fromisoformat(as_of) - datetime.date.fromisoformat(since.strip())).days)
    except ValueError:
        return None
