"""URL functions: parts, dedup keys, registrable hosts, reputation keys, safety (expression builders).

URLs are taken apart by patterns rather than by a parser that raises; a text that isn't
``scheme://host...`` has empty parts.
"""

from __future__ import annotations

from .dialect import Dialect

# Fixed values that results depend on.
ENGINE_HOSTS = ["e.so.com", "www.so.com", "www.baidu.com", "www.bing.com", "cn.bing.com", "global.bing.com", "www.sogou.com", "weixin.sogou.com", "m.sm.cn", "quark.sm.cn", "so.toutiao.com", "m.toutiao.com", "search.marginalia.nu", "hn.algolia.com", "api.github.com", "en.wikipedia.org", "www.chinaso.com", "link.zhihu.com", "www.google.com", "www.google.com.hk", "r.jina.ai", "webcache.googleusercontent.com"]
FUNCTIONAL_SEGMENTS = ["login", "signin", "signup", "register", "account", "search", "logout", "settings", "auth", "oauth"]
GENERIC_LABELS = ["www", "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "ai", "tv", "app", "xyz", "top", "site", "online", "tech", "fun", "club", "wiki", "news", "blog", "dev", "id", "cc", "ws", "mobi", "name", "pro", "asia", "tel", "live", "shop", "store", "cloud", "link", "icu", "vip", "wang", "ren", "xin"]
TRACKING = "utm_|fbclid|gclid|spm|ref|source|mtm_|_ga"
COUNTRY_SECOND = r"\.(com|net|org|gov|edu|ac|biz|info|name|co|me|tv)\.(cn|hk|tw|mo)$"

_HEAD = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def host(d: Dialect, u: str) -> str:
    return f"lower({d.ext(u, _HEAD + r'(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)', 1)})"


def path(d: Dialect, u: str) -> str:
    return d.ext(u, _HEAD + r"[^/?#]+([^?#]*)", 1)


def query(d: Dialect, u: str) -> str:
    return d.ext(u, _HEAD + r"[^?#]*\?([^#]*)", 1)


def params(d: Dialect, u: str) -> str:
    """Lower-case names of the query's parameters, in order."""
    return d.each(d.keep(d.split(query(d, u), "&"), "p", "p <> ''"), "p", f"lower({d.ext('p', '^[^=]*', 0)})")


def dedup_key(d: Dialect, u: str) -> str:
    """Without scheme, www/m/mobile, fragment, tracking parameters and one closing slash."""
    kept = d.join(d.keep(d.split(query(d, u), "&"), "p", f"p <> '' AND NOT {d.has('p', f'(?i)^({TRACKING})')}"), "&")
    bare = d.sub(host(d, u), r"^(www|m|mobile)\.")
    port = d.ext(u, _HEAD + r"(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]+)(:[0-9]+)", 1)
    whole = f"concat({bare}, {port}, CASE WHEN {path(d, u)} = '' THEN '/' ELSE {path(d, u)} END, CASE WHEN {kept} = '' THEN '' ELSE concat('?', {kept}) END)"
    return f"CASE WHEN {host(d, u)} = '' THEN {u} ELSE {d.sub(whole, '/$')} END"


def registrable(d: Dialect, u: str) -> str:
    """Registrable host; empty for engines' own hosts."""
    h = d.sub(host(d, u), r"^www\.")
    last3, last2 = d.ext("h", r"[^.]+\.[^.]+\.[^.]+$", 0), d.ext("h", r"[^.]+\.[^.]+$", 0)
    case = f"CASE WHEN {d.contains(d.texts(ENGINE_HOSTS), 'h')} THEN '' WHEN {last3} = '' THEN h WHEN {d.has(last3, COUNTRY_SECOND)} THEN {last3} ELSE {last2} END"
    return d.let(h, "h", case)


def rep_keys(d: Dialect, u: str) -> str:
    """[host, host/first segment]; identifiers, functional and file segments don't count."""
    seg = f"lower({d.ext(path(d, u), '^/*([^/]+)', 1)})"
    odd = " OR ".join([d.has("s", r"^\d+$"), d.has("s", r"^(?:19|20)\d{2}[-_]\d{1,2}(?:[-_]\d{1,2})?$"), d.contains(d.texts(FUNCTIONAL_SEGMENTS), "s"), d.has("s", r"(?i)\.(html?|php|jsp|aspx|json)$")])
    keys = f"CASE WHEN r = '' THEN {d.keep(d.array('r'), 'k', 'false')} WHEN s = '' OR {odd} THEN {d.array('r')} ELSE {d.array('r', 'concat(r, ' + d.lit('/') + ', s)')} END"
    return d.let(registrable(d, u), "r", d.let(seg, "s", keys))


def functional(d: Dialect, u: str) -> str:
    return d.has(u, r"(?i)/(?:landing|wz|wap|search|click)(?:[/?#]|$)")


def stem(d: Dialect, u: str) -> str:
    return d.ext(d.sub(host(d, u), r"^(www|m|mobile|wap)\."), r"^[^.]+", 0)


def tokens(d: Dialect, u: str) -> str:
    """``u:`` path parts (digits as n) and ``d:`` telling host labels."""
    parts = d.keep(d.each(d.split(f"lower({path(d, u)})", r"[/.\-]"), "s", d.sub("s", r"^\d+$", "n")), "s", "s = 'n' OR (length(s) >= 2 AND length(s) <= 24)")
    labels = d.keep(d.split(host(d, u), r"\."), "l", f"length(l) >= 3 AND length(l) <= 24 AND NOT {d.has('l', r'^\d+$')} AND NOT {d.contains(d.texts(GENERIC_LABELS), 'l')}")
    return d.distinct(d.chain(d.each(parts, "s", "concat('u:', s)"), d.each(labels, "l", "concat('d:', l)")))


def redirect_target(d: Dialect, u: str) -> str:
    """Target that a result redirect carries in ``u`` as a1 and unpadded URL-safe base64; else the URL."""
    code = d.sub(d.ext(u, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), "x^")
    padded = f"rpad(translate(c, '-_', '+/'), CAST(4 * ceil(length(c) / 4.0) AS INT), '=')"
    text = f"decode(unbase64({padded}), 'UTF-8')" if d.spark else f"decode(from_base64({padded}))"
    return d.let(code, "c", f"CASE WHEN c = '' THEN {u} ELSE {text} END")


def scrubbed(d: Dialect, u: str) -> str:
    """Without parameters that only say where a news link was shown."""
    names = "channel|in_ogs|in_tfs|original_source|source|traffic_source|upstream_biz|utm_[a-z_]+"
    bare = d.sub(d.sub(d.sub(u, f"[?&](?:{names})=[^&]*"), "&{2,}", "&"), r"[?]&", "?")
    return d.sub(bare, "[?&]$")


def cache_key(d: Dialect, u: str) -> str:
    return f"sha1({d.sub(u, '#.*$')})"


def unsafe_reason(d: Dialect, u: str) -> str:
    """Why a URL must not be fetched; null if it may."""
    num = lambda k: f"CAST({d.ext('h', r'^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$', k)} AS INT)"
    a, b = num(1), num(2)
    v4 = f"({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 100 AND {b} BETWEEN 64 AND 127) OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} IN (0, 168)) OR ({a} = 198 AND {b} IN (18, 19)))"
    case = f"""CASE WHEN {d.ext(u, _HEAD, 0)} = '' OR h = '' THEN 'invalid'
      WHEN NOT {d.has(u, '(?i)^https?://')} THEN 'scheme'
      WHEN {d.has(u, _HEAD + '[^/?#]*@')} THEN 'credentials'
      WHEN h = 'localhost' OR {d.has('h', r'\.localhost$')} THEN 'localhost'
      WHEN {d.has('h', r'^(\d+|0x[0-9a-f]+)$')} THEN 'integer-host'
      WHEN {d.has('h', r'^\d{1,3}(\.\d{1,3}){3}$')} THEN CASE WHEN {v4} THEN 'non-public' END
      WHEN {d.has('h', r'^\[')} AND (NOT {d.has('h', r'^\[[23][0-9a-f]{3}:')} OR {d.has('h', r'^\[2001:db8:')}) THEN 'non-public' END"""
    return d.let(host(d, u), "h", case)


def article_score(d: Dialect, u: str) -> str:
    """How much a URL looks like an article's: dates, long numbers, file endings, depth."""
    p = "p"
    segs = d.keep(d.split(p, "/"), "s", "s <> ''")
    n = d.size(segs)
    bare_second = f"({n} = 2 AND NOT {d.has(d.at(segs, '2'), r'[.][A-Za-z0-9_]+$')})"
    points = [(d.has(p, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})"), 3), (d.has(p, r"/\d{4,}/"), 2), (d.has(p, r"(?i)\.(s?html?|shtm)$"), 1), (f"{n} >= 3", 1), (bare_second, -1)]
    return d.let(path(d, u), "p", "CAST(" + " + ".join(f"CASE WHEN {c} THEN {k} ELSE 0 END" for c, k in points) + " AS BIGINT)")
