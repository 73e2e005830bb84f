"""Text functions: cleaning, titles, tokens, lines and sentences (expression builders)."""

from __future__ import annotations

from .dialect import CJK, WHITE, Dialect

# Fixed values that results depend on: entities and stop words.
NAMED_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&ensp;": " ", "&emsp;": " ", "&middot;": "·", "&shy;": ""}
STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "your", "you", "are", "was", "have", "has", "not", "but", "all", "can", "how", "what", "when", "where", "why"]
BRAND_ALIASES = {"苹果": "apple", "微博": "weibo", "抖音": "douyin", "微信": "wechat", "淘宝": "taobao", "京东": "jd", "腾讯": "tencent", "华为": "huawei", "小米": "xiaomi", "百度": "baidu", "知乎": "zhihu", "网易": "netease", "优酷": "youku", "谷歌": "google", "微软": "microsoft"}
SITE_HINTS = ["csdn", "知乎", "博客园", "百度百科", "维基百科", "什么值得买", "简书", "掘金", "infoq", "豆瓣", "央视网", "人民日报", "人民网", "腾讯网", "网易", "新浪", "搜狐", "头条", "澎湃", "界面新闻", "36氪", "虎嗅", "少数派", "汽车之家", "中关村在线", "哔哩哔哩", "微博", "微信公众号", "github", "stackoverflow", "mdn", "w3school", "官方", "官网", "首页", "百科", "门户", "技术社区"]

_WIDE = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


_TAIL = r"(?:[_|｜·•-]\s*)+([^_|｜·•-]{0,16})$"


def trimmed(d: Dialect, s: str) -> str:
    return d.sub(d.sub(s, f"^{WHITE}+"), f"{WHITE}+$")


def strip_tags(d: Dialect, s: str) -> str:
    """Without tags, scripts and styles; white space collapsed and trimmed."""
    s = d.sub(d.sub(s, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return trimmed(d, d.sub(d.sub(s, r"<[^>]+>", " "), f"{WHITE}+", " "))


def decode_entities(d: Dialect, s: str) -> str:
    """Percent forms, named entities, then ampersands and numeric entities of all characters."""
    s = f"replace(replace({s}, '%26', '&'), '%3B', ';')"
    for name, char in NAMED_ENTITIES.items():
        s = f"replace({s}, {d.lit(name)}, {d.lit(char)})"
    s = d.sub(f"replace({s}, '&amp;', '&')", r"(?i)&amp([^a-z0-9#]|$)", "&$1")
    return d.let(s, "s", numeric_entities(d, "s"))


def numeric_entities(d: Dialect, s: str) -> str:
    """With decimal and hexadecimal entities as their characters; numbers that are none stay."""
    code = f"CASE WHEN substr(e, 3, 1) = 'x' THEN {d.from_hex('substr(e, 4, length(e) - 4)')} ELSE CAST(substr(e, 3, length(e) - 3) AS BIGINT) END"
    found = d.each(d.distinct(d.every(s, "&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});")), "e", d.pair("e", code))
    valid = d.keep(found, "p", "(p.code BETWEEN 1 AND 55295 OR p.code BETWEEN 57344 AND 1114111)")
    return d.fold(valid, s, "p", lambda t: f"replace({t}, p.text, {d.char('p.code')})")


def clean(d: Dialect, s: str) -> str:
    """Display text: no tags or entities, white space collapsed, none between wide characters."""
    s = d.sub(decode_entities(d, strip_tags(d, s)), f"{WHITE}+", " ")
    s = f"replace({s}, {d.lit(chr(0xAD))}, '')"
    for _ in range(2):  # matches don't overlap: neighbours on both sides need a second turn
        s = d.sub(s, f"({_WIDE}){WHITE}+({_WIDE})", "$1$2")
    s = d.sub(s, f"([，。；：！？、）】」』》]){WHITE}+", "$1")
    return trimmed(d, d.sub(s, f"{WHITE}+([（【「『《])", "$1"))


def strip_control(d: Dialect, s: str) -> str:
    """Without terminal sequences and control characters other than tab and line ends."""
    s = d.sub(s, r"\x1b\[[0-9;?]*[ -/]*[@-~]")
    s = d.sub(s, r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)")
    return d.sub(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]")


def normalize_title(d: Dialect, s: str) -> str:
    return f"substr({d.sub(d.sub(f'lower({s})', f'{WHITE}+'), r'[|｜·•_—–-]')}, 1, 80)"


def label_title(d: Dialect, s: str) -> str:
    """Without up to four trailing parts of 16 characters at most that name a site."""
    hints = "|".join(h.replace(".", r"\.") for h in SITE_HINTS)
    s = trimmed(d, s)
    for _ in range(4):
        tail = f"lower({d.ext(s, _TAIL, 1)})"
        s = trimmed(d, f"CASE WHEN {d.has(tail, hints)} THEN {d.sub(s, _TAIL)} ELSE {s} END")
    return s


def grams(d: Dialect, s: str, n: int, most: int | None = None) -> str:
    """Distinct CJK n-grams after white space goes; of the first ``most`` characters."""
    t = d.sub(s, f"{WHITE}+")
    t = f"substr({t}, 1, {most})" if most else t
    if d.spark:  # one pass; the other engine has no look-ahead
        return d.distinct(d.every(t, f"(?={'(' + CJK}{{{n}}}))", 1))
    inner = d.keep(d.each(d.upto(f"length(t) - {n - 1}"), "i", f"substr(t, CAST(i AS INT), {n})"), "g", d.has("g", f"^{CJK}{{{n}}}$"))
    return d.distinct(d.let(t, "t", inner))


def words_plain(d: Dialect, s: str) -> str:
    """Distinct runs of three letters or more, without stop words."""
    return d.distinct(d.keep(d.every(f"lower({s})", "[a-z]{3,}"), "w", f"NOT {d.contains(d.texts(STOP_WORDS), 'w')}"))


def words_mixed(d: Dialect, s: str) -> str:
    """Distinct words that start with a letter, and numbers of two to ten digits."""
    return d.distinct(d.every(f"lower({s})", "[a-z][a-z0-9]{1,19}|[0-9]{2,10}"))


def title_tokens(d: Dialect, s: str, stop: list[str] | None = None) -> str:
    """``c:`` grams of 2 to 4 and ``e:`` words; grams that are, start or end with a stop word go."""
    grams_ = d.chain(*(grams(d, s, n) for n in (2, 3, 4)))
    for w in stop or ():
        grams_ = d.keep(grams_, "g", f"NOT (g = {d.lit(w)} OR (length(g) > {len(w)} AND (substr(g, 1, {len(w)}) = {d.lit(w)} OR substr(g, length(g) - {len(w) - 1}, {len(w)}) = {d.lit(w)})))")
    return d.distinct(d.chain(d.each(grams_, "g", "concat('c:', g)"), d.each(words_plain(d, s), "w", "concat('e:', w)")))


def query_tokens(d: Dialect, s: str) -> str:
    """Tokens of a query as text ``token=weight``; aliases of brands weigh one half."""
    base = d.chain(d.each(grams(d, s, 2), "g", "concat('c:', g, '=1')"), d.each(words_plain(d, s), "w", "concat('e:', w, '=1')"))
    alias = "CASE g " + " ".join(f"WHEN {d.lit(k)} THEN {d.lit('e:' + v + '=0.5')}" for k, v in BRAND_ALIASES.items() if len(k) == 2) + " END"
    return d.distinct(d.chain(base, d.keep(d.each(grams(d, s, 2), "g", alias), "a", "a IS NOT NULL")))


def body_tokens(d: Dialect, s: str, most: int = 1600) -> str:
    return d.distinct(d.chain(grams(d, f"substr({s}, 1, {most})", 2, most), words_mixed(d, f"substr({s}, 1, {most})")))


def normalized_lines(d: Dialect, s: str) -> str:
    """Lines of 20 characters or more, list markers stripped and white space collapsed."""
    line = trimmed(d, d.sub(d.sub("l", f"{WHITE}+", " "), r"^ *[#>*0-9.、-]+ *", ""))
    return d.keep(d.each(d.split(s, r"\n+"), "l", line), "l", "length(l) >= 20")


def repetition(d: Dialect, s: str) -> str:
    """Share of repeated normalised lines; 0 below four lines."""
    return d.let(normalized_lines(d, s), "ls", f"CASE WHEN {d.size('ls')} < 4 THEN {d.num(0.0)} ELSE ({d.size('ls')} - {d.size(d.distinct('ls'))}) / CAST({d.size('ls')} AS DOUBLE) END")


def sentence_lengths(d: Dialect, s: str) -> str:
    parts = d.split(d.sub(s, f"{WHITE}+", " "), r"[。！？!?；;\n]+")
    return d.each(d.keep(d.each(parts, "p", trimmed(d, "p")), "p", "length(p) >= 8"), "p", "CAST(length(p) AS DOUBLE)")


def cv(d: Dialect, lengths: str) -> str:
    """Coefficient of variation of an array of doubles; null below eight."""
    n = f"CAST({d.size('ns')} AS DOUBLE)"
    mean = f"({d.total('ns')} / {n})"
    var = f"({d.total(d.each('ns', 'q', f'(q - {mean}) * (q - {mean})'))} / {n})"
    return d.let(lengths, "ns", f"CASE WHEN {d.size('ns')} >= 8 THEN sqrt({var}) / {mean} END")


def sentence_cv(d: Dialect, s: str) -> str:
    """Coefficient of variation of sentence lengths; null below eight sentences."""
    return cv(d, sentence_lengths(d, s))


def sentence_count(d: Dialect, s: str) -> str:
    return d.size(sentence_lengths(d, s))


def first_paragraph(d: Dialect, s: str) -> str:
    """First line of 12 characters or more, Markdown images, links and markers stripped; 150 at most."""
    line = d.sub(d.sub("l", r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    line = trimmed(d, d.sub(line, r"^[#>\s]+", ""))
    return f"coalesce(substr({d.at(d.keep(d.each(d.split(s, chr(92) + 'n+'), 'l', line), 'l', 'length(l) >= 12'), '1')}, 1, 150), '')"


def title_coverage(d: Dialect, title: str, body: str) -> str:
    """Share of the title's terms that the body holds; null without terms."""
    terms = d.distinct(d.chain(grams(d, title, 2, 60), words_mixed(d, title)))
    low = f"lower({body})"
    hit = f"contains(b, t)"
    return d.let(low, "b", d.let(terms, "ts", f"CASE WHEN {d.size('ts')} > 0 THEN {d.size(d.keep('ts', 't', hit))} / CAST({d.size('ts')} AS DOUBLE) END"))


def shares_run(d: Dialect, a: str, b: str, length: str) -> str:
    """Whether two texts share a run of ``length`` characters.

    Such a run holds one of the blocks of half its length that the first text is cut into.  Spark
    looks for these first, and for whole runs just around the blocks that the second text has.
    """
    if d.spark:
        run = f"i <= m - n + 1 AND contains({b}, substr({a}, CAST(i AS INT), n))"
        around = f"exists(sequence(greatest(1, k * h + h + 1 - n), k * h + 1), i -> {run})"
        blocks = f"exists(sequence(0, CAST(m DIV h AS INT)), k -> contains({b}, substr({a}, k * h + 1, h)) AND k * h + h <= m AND {around})"
        return d.let(f"CAST({length} AS INT)", "n", d.let("CAST((n + 1) DIV 2 AS INT)", "h", d.let(f"length({a})", "m", blocks)))
    return d.any(d.upto(f"length({a}) - {length} + 1"), "i", f"contains({b}, substr({a}, CAST(i AS INT), CAST({length} AS INT)))")


def near_title(d: Dialect, a: str, b: str) -> str:
    """Titles of eight characters or more that share a run of 12 and of 55 % of the shorter."""
    need = "greatest(12, CAST(ceil(55 * least(length(x), length(y)) / 100.0) AS INT))"
    return d.let(normalize_title(d, a), "x", d.let(normalize_title(d, b), "y", f"(length(x) >= 8 AND length(y) >= 8 AND {shares_run(d, 'x', 'y', need)})"))


def bare_description(d: Dialect, s: str) -> str:
    """What is compared of a description; of a bare one all."""
    return f"substr({d.sub(s, f'{WHITE}+')}, 1, 4096)"


def near_description(d: Dialect, a: str, b: str) -> str:
    """Descriptions of 20 characters or more that share a run of 20 and of 40 % of the shorter."""
    need = "greatest(20, CAST(ceil(4 * least(length(x), length(y)) / 10.0) AS INT))"
    return d.let(bare_description(d, a), "x", d.let(bare_description(d, b), "y", f"(length(x) >= 20 AND length(y) >= 20 AND {shares_run(d, 'x', 'y', need)})"))


def light_clean(d: Dialect, s: str) -> str:
    """Without tags; the commonest entities decoded, white space collapsed and trimmed."""
    s = d.sub(d.sub(s, "<[^>]+>"), "(?i)&nbsp;|&#160;", " ")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        s = f"replace({s}, {d.lit(name)}, {d.lit(char)})"
    return trimmed(d, d.sub(s, f"{WHITE}+", " "))


#: Fixed values that results depend on: how much of a title, a description, both and a query is embedded.
EMBED_TITLE, EMBED_DESC, EMBED_ALL, EMBED_QUERY = 200, 400, 512, 256


def embedded_text(d: Dialect, title: str, desc: str) -> str:
    return f"substr(trim(concat(substr(coalesce({title}, ''), 1, {EMBED_TITLE}), ' ', substr(coalesce({desc}, ''), 1, {EMBED_DESC}))), 1, {EMBED_ALL})"


def embedded_query(d: Dialect, q: str) -> str:
    return f"concat('查询:', substr(trim({q}), 1, {EMBED_QUERY}))"


def holds_label(d: Dialect, title: str, label: str) -> str:
    """Whether a title holds a label in any case; one of letters alone only as whole words."""
    low = f"lower({label})"
    whole = f"{'regexp_like' if d.spark else 'regexp_matches'}(lower({title}), concat('(^|[^a-z])', {low}, '($|[^a-z])'))"
    return f"CASE WHEN {label} = '' THEN false WHEN {d.has(low, '^[a-z]+$')} THEN {whole} ELSE contains(lower({title}), {low}) END"


def as_in_titles(d: Dialect, value: str, titles: str) -> str:
    """A value as the first of the titles that has it writes it."""
    first = d.at(d.keep(titles, "t", f"contains(lower(t), lower({value}))"), "1")
    return f"CASE WHEN {d.has(value, '(?i)[a-z]')} THEN coalesce(substr({first}, CAST(instr(lower({first}), lower({value})) AS INT), length({value})), {value}) ELSE {value} END"


def own_segment(d: Dialect, title: str, others: str, label: str, most: int = 14) -> str:
    """The longest part of a title between separators that no other title holds and that lacks the label.

    Else the longest part; empty without other titles.  Parts have two characters or more, the
    first of equal ones counts.
    """
    parts = d.keep(d.split(title, r"[_\-|｜·•,，、;；:：()（）\[\]【】<>《》\"'“”…\s]+"), "p", "length(p) >= 2")
    free = d.keep("ps", "p", f"NOT {d.any(others, 'o', 'contains(o, p)')} AND ({label} = '' OR NOT contains(p, {label}))")
    longest = lambda xs: d.at(d.keep(xs, "p", f"length(p) = {d.most(d.each(xs, 'w', 'length(w)'))}"), "1")
    return f"CASE WHEN {d.size(others)} = 0 THEN '' ELSE {d.let(parts, 'ps', f'substr(coalesce({longest(free)}, {longest("ps")}, {title}), 1, {most})')} END"


def flag_tokens(d: Dialect, flags: str) -> str:
    """``f:`` tokens of low-quality flags; advertising says nothing about a site."""
    own = d.keep(flags, "f", "NOT starts_with(f, 'ad:')" if not d.spark else "NOT startswith(f, 'ad:')")
    return d.distinct(d.each(own, "f", f"concat('f:', {d.sub('f', '^low:')})"))


def title_flag_tokens(d: Dialect, title: str, flags: str) -> str:
    """Features of a result whose address tells nothing of its site: of title and flags alone."""
    said = d.chain(grams(d, title, 2), words_mixed(d, title))
    return d.distinct(d.chain(d.each(said, "w", "concat('t:', w)"), flag_tokens(d, flags)))


def learned_features(d: Dialect, title: str, url: str, flags: str) -> str:
    """All features of a result that site reputation learns from: of title, address and flags."""
    from . import urls

    return d.distinct(d.chain(title_flag_tokens(d, title, flags), urls.tokens(d, url)))
