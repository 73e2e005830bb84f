"""Each operator against a brute-force version on a small table with the awkward rows in it."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from resultlake.llm import bpe, decontaminate, fingerprint, lines, lm, quality, shared, simhash, suffix, tokenfiles, toxicity

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix very potent brews in old copper kettles near the quiet river bank"
LONG = " ".join(f"word{i * 7919 % 997} filler" for i in range(4000))
TEXTS = [
    (0, PROSE), (1, PROSE), (2, PROSE.replace("lazy", "sleepy")), (3, None), (4, ""), (5, "one"), (6, "Two  words\n"), (7, LONG), (8, "tab\tand\nnewline\n\nA shared line of some length that repeats.\nlast"),
    (9, "A shared line of some length that repeats!\nother text here"), (10, "   "), (11, "é ñ 中文 😀 don't we'll 1234 ...!!"), (12, PROSE + " " + LONG[:900]), (12, PROSE + " " + LONG[:900]), (None, "no id here at all"), (50, "a shared line of some length that repeats.\n" * 3),
]
COLUMNS = "doc_id bigint, text string, key string, id int, toxicity string, n_lines string, hash int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 7, "x", "y", 3) for i, t in TEXTS], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def grouped(items, like):
    root = {i: i for i in items}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in items:
        for j in items:
            if i < j and like(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (8, 20), (None, 4)], "a bigint, b bigint")
    assert rows_of(shared.components(edges), "node", "root") == [(1, 1), (2, 1), (20, 8), (3, 1), (8, 8), (9, 8)]
    assert shared.components(edges.limit(0)).count() == 0


def test_words_and_shingles():
    column = pa.array(["A b  c", None, "", "a b c", "x y z w v u"])
    w = shared.Words(*shared.buffers(column), 0, 5)
    assert w.counts.tolist() == [3, 0, 0, 3, 6]
    assert (w.hash[:3] == w.hash[3:6]).all()
    h, doc = w.shingles(5)
    assert doc.tolist() == [0, 3, 4, 4] and h[0] == h[1] and len(set(h.tolist())) == 3


def fp(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {fp(t) for _, t in TEXTS}
    root = grouped(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in TEXTS:
        if i is not None:
            least[root[fp(t)]] = min(i, least.get(root[fp(t)], 1 << 60))
    assert got == {(i, fp(t)): least.get(root[fp(t)]) for i, t in TEXTS}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))


def test_golay_links(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (12, 2))} | set(base))
    want = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for bucket in (2, 64):
        found = {r.node: r.root for r in shared.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), bucket)).collect()}
        assert {f: found.get(f, f) for f in fps} == want


def test_golay_codewords_share_a_key_within_one_bit():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 2000)
    y = x ^ (1 << rng.integers(0, 23, 2000))
    assert all(set(a) & set(b) for a, b in zip(simhash.codewords(x).tolist(), simhash.codewords(y).tolist(), strict=True))


def test_fingerprints(docs, none):
    got = fingerprint.with_next(docs)
    known = sorted(((i, t or "") for i, t in TEXTS if i is not None)) + [(None, t) for i, t in TEXTS if i is None]
    follow = [t for _, t in known[1:]] + [known[0][1]]
    want = sorted(((i, len(t), hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()) for (i, t), n in zip(known, follow, strict=True)), key=repr)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == want
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint and by[0].near_next == 1.0
    assert by[3].fingerprint == "" and 0 <= by[2].near_edited <= 1
    assert fingerprint.with_next(none).count() == 0
    assert fingerprint.with_next(docs.where("doc_id = 7")).first().near_next == 1.0
    assert fingerprint.fingerprints(docs).count() == len(TEXTS)


def test_fingerprint_likeness_is_unbiased():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(500)]
    misses = []
    for share in (0.2, 0.5, 0.9):
        for _ in range(20):
            a = rng.choice(vocab, 300)
            b = np.where(np.arange(300) < 300 * share, a, rng.choice(vocab, 300))
            sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in (a.tolist(), b.tolist())]
            sig, there = fingerprint.signatures(*shared.buffers(pa.array([" ".join(a), " ".join(b)])))
            misses.append(fingerprint.likeness(sig[:1], there[:1], sig[1:], there[1:])[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(misses)) < 0.02 and np.std(misses) < 0.06


def brute_suffix(texts, length):
    counts = Counter()
    raw = [(t or "").encode() for _, t in texts]
    for x in raw:
        counts.update(x[i : i + length] for i in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(texts, raw, strict=True):
        cover = bytearray(len(x))
        for at in range(len(x) - length + 1):
            if counts[x[at : at + length]] > 1:
                cover[at : at + length] = b"\1" * length
        runs = sum(1 for at in range(len(x)) if cover[at] and not (at and cover[at - 1]))
        out.append((i, len(x), sum(cover), runs, bytes(b for b, c in zip(x, cover, strict=True) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [1000, 1])
def test_suffix_dedup(spark, docs, none, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup(docs).collect()), key=repr)
    assert got == brute_suffix(TEXTS, suffix.LENGTH)
    assert suffix.dedup(none).count() == 0
    part = LONG[200:700]
    near = [(i, f"{i} {hashlib.sha256(str(i).encode()).hexdigest() * 3} {part[i:]} {i * i} " + ("ab" * 300 if i % 5 == 0 else "")) for i in range(30)]
    made = suffix.dedup(spark.createDataFrame(near, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in made.collect()), key=repr) == brute_suffix(near, suffix.LENGTH)


def test_suffix_array_orders_by_prefix():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 1500).astype(np.uint8)
    text[500:1000] = text[:500]
    wanted = np.zeros(1500, bool)
    wanted[:1100] = True
    order = suffix.suffix_array(text, wanted)
    raw = text.tobytes()
    assert sorted(order.tolist()) == list(range(1100))
    keys = [raw[p : p + suffix.LENGTH] for p in order.tolist()]
    assert keys == sorted(keys)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.vocabulary_file(spark)


def test_pretokens_match_the_pattern(vocabulary):
    assert bpe.KNOWN_PATTERN == vocabulary[1]
    rng = np.random.default_rng(5)
    parts = ["a", "s", "t", " ", "  ", "'", "\n", "re", "ll", "1", "²", "é", " ", "　", "!", "…", "中", "😀", "d", "\t", "ve", "m", "̈", "S"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 30, 3000)]
    data, off = shared.buffers(pa.array(texts))
    begin = bpe.pretokens(data, off)
    want, find = [], regex.compile(vocabulary[1]).findall
    for at, t in zip(off[:-1].tolist(), texts, strict=True):
        for w in find(t):
            want.append(at)
            at += len(w.encode())
    assert begin.tolist() == want


@pytest.mark.parametrize("hot", [bpe.HOT, 3])
def test_bpe(docs, none, vocabulary, monkeypatch, hot):
    monkeypatch.setattr(bpe, "HOT", hot)
    encode = bpe.encoding(*vocabulary).encode_ordinary
    want = sorted(((i, np.array(encode(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS), key=repr)
    got = bpe.encode(docs, *vocabulary)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=repr) == want
    assert bpe.encode(none, *vocabulary).count() == 0
    digest = {r.doc_id: r for r in bpe.digests(got).collect()}[7]
    assert digest.n_tokens == len(encode(LONG)) and digest.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


@pytest.mark.parametrize("hot", [bpe.HOT, 1])
def test_bpe_of_regular_words(spark, vocabulary, monkeypatch, hot):
    """Thue-Morse words and their complements collide in polynomial hashes modulo 2^64."""
    monkeypatch.setattr(bpe, "HOT", hot)
    texts = []
    for bits in (10, 11, 12, 13):
        word = "".join("ab"[k.bit_count() & 1] for k in range(1 << bits))
        texts += [word, word.translate(str.maketrans("ab", "ba"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode(rows, *vocabulary).collect()} == dict(enumerate(texts))
    w = shared.Words(*shared.buffers(pa.array(texts)), 0, len(texts))
    assert len(set(w.hash.tolist())) == len(texts)


def test_bpe_with_another_pattern(docs, vocabulary):
    own = r"\S+|\s+"
    encode = bpe.encoding(vocabulary[0], own).encode_ordinary
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(docs.where("doc_id IN (6, 11)"), vocabulary[0], own).collect()}
    assert got == {i: np.array(encode(t), "<u4").tobytes() for i, t in TEXTS if i in (6, 11)}


@pytest.mark.parametrize("block", [tokenfiles.BLOCK, 7])
def test_token_counts(spark, docs, vocabulary, block):
    encode = bpe.encoding(*vocabulary).encode_ordinary
    order = tokenfiles.write(docs, f"{shared.shared_folder(spark)}/test-tokens", *vocabulary)
    counted = order.join(tokenfiles.count(tokenfiles.sizes(spark, order), block=block), ["file", "nth"])
    assert rows_of(counted, "doc_id", "n_tokens") == sorted(((i, len(encode(t or ""))) for i, t in TEXTS), key=repr)


def test_token_counts_of_a_file_without_last_separator(spark, tmp_path):
    end = tokenfiles.END_OF_TEXT
    np.array([1, 2, end, end, 5, 6, 7], "<u2").tofile(tmp_path / "a")
    np.array([end], "<u2").tofile(tmp_path / "b")
    np.array([], "<u2").tofile(tmp_path / "c")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in "abc"], "file string")
    got = tokenfiles.count(tokenfiles.sizes(spark, files), block=3)
    assert [(r.file[-1], r.nth, r.begin, r.n_tokens) for r in got.orderBy("file", "nth").collect()] == [("a", 0, 0, 2), ("a", 1, 3, 0), ("a", 2, 4, 3), ("b", 0, 0, 0)]


def brute_lines(texts):
    sets = {}
    for _, t in texts:
        for line in (t or "").split("\n"):
            if m := line.strip(" ").lower():
                sets[m] = {m[i : i + 5] for i in range(len(m) - 4)} if len(m) >= 5 else {m}
    return grouped(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_line_dedup(docs, none):
    root = brute_lines(TEXTS)
    got = lines.dedup(docs)
    assert set(docs.columns) <= set(got.columns)
    left = [m for r in got.collect() for line in (r.text or "").split("\n") if (m := line.strip(" ").lower())]
    repeated_row = Counter(root[m] for m in left)
    twice = {root[line.strip(" ").lower()] for i, t in TEXTS if i == 12 for line in t.split("\n")}
    assert all(n == (2 if k in twice and k in {root[x] for x in left} and n == 2 else 1) for k, n in repeated_row.items())
    assert set(repeated_row) == set(root.values())
    assert {r.doc_id: r.text for r in got.collect()}[3] is None
    assert sum(r.n_removed for r in got.collect()) > 0
    assert lines.dedup(none).count() == 0


def found_pairs(spark, texts):
    """Pairs of lines that are candidates, in small buckets, and lines of large ones."""
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select(F.xxhash64("line").alias("lid"), lines._signed("line").alias("signed"))
    return lines._candidates(rows.select("lid", "signed.sig", "signed.sketch"))


def test_line_candidates_of_few_words(spark):
    a = "counterrevolutionaries internationalization misunderstanding"
    for b in (a.replace("inter", "intar"), a[:-2] + "xy", a.replace("counter", "counxer")):
        assert brute_lines([(0, a), (1, b)])[a] == brute_lines([(0, a), (1, b)])[b]
        assert found_pairs(spark, [a, b])[0].count() == 1, b
    assert found_pairs(spark, ["one two three four five six seven-eight nine", "one two three four five six seven eight nine"])[0].count() == 1


def test_line_dedup_keeps_blank_lines(spark):
    text = "same line\r\n\r\n\t\n same line\t\n\r\n\t\nend"
    got = lines.dedup(spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, key string")).first()
    assert got.text == "same line\r\n\r\n\t\n\r\n\t\nend" and (got.n_lines, got.n_removed, got.key) == (7, 1, "x")


def boilerplate(rng, head, tail, n, edits=2):
    """Lines of one head and own tails; some tails are those of others with a letter changed."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(3, 9))))
    start = " ".join(word() for _ in range(head))
    tails = [[word() for _ in range(tail)] for _ in range(n // 2)]
    out = [f"{start} {' '.join(t)}" for t in tails]
    for t in tails:
        for _ in range(edits):
            t = list(t)
            k = int(rng.integers(tail))
            t[k] = t[k][:-1] + "z"
            out.append(f"{start} {' '.join(t)}")
    return out


def test_line_dedup_recall(spark):
    """Recall of alike pairs by component, on lines with much in common."""
    rng = np.random.default_rng(11)
    base = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(9, 18)))) for _ in range(int(rng.integers(2, 6)))) for _ in range(150)]
    kinds = [base + [t[:k] + "z" + t[k + 1 :] for t in base for k in [int(rng.integers(len(t)))]]]
    kinds += [boilerplate(rng, head, tail, 120) for head, tail in ((14, 8), (20, 4), (17, 3), (34, 6))]
    texts = [(i, t, k) for k, ts in enumerate(kinds) for i, t in enumerate(ts)]
    got = lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string, kind int"))
    whole = Counter(r.kind for r in got.where("text <> ''").collect())
    for k, ts in enumerate(kinds):
        sets = {t: {t[i : i + 5] for i in range(len(t) - 4)} for t in set(ts)}
        root = {t: t for t in sets}

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        for a, b in alike:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = len({find(t) for t in sets})
        assert len(alike) > 50 and want <= whole[k] <= want + 0.01 * len(alike), k


def test_line_dedup_of_a_large_family(spark, monkeypatch):
    """Variants like the original, but not like each other, and unlike lines with the same start."""
    monkeypatch.setattr(lines, "BLOCK_GRAMS", 4_000)
    base = [f"{w}{k}" for k in range(3) for w in PROSE.split()[:14]]
    rng = np.random.default_rng(5)

    def edited(words, n):
        words = list(words)
        for k in rng.choice(len(words), n, replace=False):
            words[k] = "".join(rng.choice(list("bcdfgh"), len(words[k])))
        return " ".join(words)

    family = [" ".join(base)] + [edited(base, 2) for _ in range(300)]
    others = [" ".join(base[:25]) + " " + edited(base[25:], 17) for _ in range(60)]
    texts = list(enumerate(family + others))
    root = brute_lines(texts)
    assert 1 < len(set(root.values())) < len(texts) / 2
    got = lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert Counter(root[r.text] for r in got.collect() if r.text) == Counter(set(root.values()))

def test_line_dedup_copies_in_turns(spark, monkeypatch):
    """More blocks are more turns, not larger ones, and all lines' texts are gone by then."""
    monkeypatch.setattr(lines, "BLOCK_GRAMS", 4_000)
    monkeypatch.setattr(lines, "TURN", 100_000)
    rng = np.random.default_rng(3)
    texts = list(enumerate(boilerplate(rng, 20, 12, 60)))
    turns, real = [], shared.stage

    def stage(df, name="stage", **how):
        if name == "line-firsts":
            turns.clear()
        out = real(df, name, **how)
        if name == "line-turn":
            turns.append(any("/line-firsts-" in path for home in shared._scratches for path in home))
        return out

    monkeypatch.setattr(shared, "stage", stage)
    got = lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string"))
    root = brute_lines(texts)
    assert Counter(root[r.text] for r in got.collect() if r.text) == Counter(set(root.values()))
    assert len(turns) > 2 and not any(turns)


def test_line_dedup_copies_grow_with_the_bucket(spark, monkeypatch):
    """Four times as many unlike lines of one head: about four times as many copied shingles, not sixteen."""
    monkeypatch.setattr(lines, "BLOCK_GRAMS", 4_000)
    copied, real = [], lines._in_turns

    def in_turns(rows, n, *rest):
        copied[-1] += n or 0
        return real(rows, n, *rest)

    monkeypatch.setattr(lines, "_in_turns", in_turns)
    for n in (120, 480):
        copied.append(0)
        texts = list(enumerate(boilerplate(np.random.default_rng(3), 20, 12, n, edits=0)))
        assert lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string")).where("text <> ''").count() == len(texts)
    assert 0 < copied[1] < 6 * copied[0], copied


def test_line_meetings_leave_out_what_shares_too_few_first_shingles(spark):
    """Two of 100 shingles shared, first ones: met, but unlike by count; 90 of 100 shared stay a pair."""
    own = lambda k: list(range(1_000 * k, 1_000 * k + 98))
    sets = {1: [1, 2] + own(1), 2: [1, 2] + own(2), 3: own(3) + [7, 8], 4: own(3)[:88] + [7, 8] + own(4)[:10]}
    every = [(10 * k + n, own(k)) for k in (1, 2, 3, 4) for n in range(3)]  # so that own shingles come after shared ones
    inside = spark.createDataFrame(list(sets.items()) + every, "lid bigint, grams array<int>")
    rooms = spark.createDataFrame([(0, k, k, len(s)) for k, s in sets.items()] + [(0, 99, 99, 100)], "room bigint, lid bigint, label bigint, w int")
    met = {tuple(sorted((r.a, r.b))) for r in lines._meetings(rooms, inside, 0.8).collect()}
    assert met == {(3, 4)}


def test_line_dedup_moves_whole_lines_in_passes(spark, monkeypatch):
    """No staged table holds all whole lines at once, with or without broadcasts."""
    rng = np.random.default_rng(4)
    texts = list(enumerate(boilerplate(rng, 20, 6, 60) + boilerplate(rng, 3, 9, 60)))
    root, real = brute_lines(texts), shared.stage
    for most in (lines.BROADCAST_ROWS, 20):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
        staged = {"line-firsts": [], "line-held": []}

        def stage(df, name="stage", staged=staged, **how):
            out = real(df, name, **how)
            if name in staged:
                staged[name].append(out.count())
            return out

        monkeypatch.setattr(shared, "stage", stage)
        got = lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string"))
        assert Counter(root[r.text] for r in got.collect() if r.text) == Counter(set(root.values()))
        assert sum(staged["line-firsts"]) == len(root) and max(staged["line-firsts"]) < len(root) / 2
        assert bool(staged["line-held"]) == (most == 20) and all(n < len(root) / 2 for n in staged["line-held"])


def test_line_meetings_go_in_turns(spark, monkeypatch):
    """Rows of first shingles that meet are bounded a turn, in one room as in many; pairs are the same."""
    rng = np.random.default_rng(7)
    common = [int(x) for x in rng.integers(0, 1 << 31, 90)]
    sets = {k: common[k % 6 :] + [int(x) for x in rng.integers(0, 1 << 31, 6)] for k in range(60)}
    inside = spark.createDataFrame(list(sets.items()), "lid bigint, grams array<int>")
    rooms = spark.createDataFrame([(0 if k % 2 else 1 + k % 7, k, k, len(s)) for k, s in sets.items()], "room bigint, lid bigint, label bigint, w int")
    turns, real = [], shared.stage

    def stage(df, name="stage", **how):
        turns[-1] += name == "line-turn"
        return real(df, name, **how)

    monkeypatch.setattr(shared, "stage", stage)
    found = []
    for turn in (lines.TURN, 5_000):
        monkeypatch.setattr(lines, "TURN", turn)
        turns.append(0)
        found.append({tuple(r) for r in lines._meetings(rooms, inside, 0.8).collect()})
    assert found[0] == found[1] and len(found[0]) > 100
    assert turns[0] == 1 and turns[1] > 3


def test_line_bits_rule_out_only_what_is_unlike(spark):
    """No alike pair goes, few of those that share half of their shingles stay."""
    rng = np.random.default_rng(9)
    draw = lambda n: [int(x) for x in rng.integers(0, 1 << 31, n)]
    sets, kept, gone = {}, set(), set()
    for k in range(120):
        n = int(rng.integers(6, 400))
        base, share = draw(n), (0.9, 0.95, 0.5)[k % 3]
        sets[2 * k], sets[2 * k + 1] = base, base[: math.ceil(share * n)] + draw(n - math.ceil(share * n))
        same = len(set(sets[2 * k]) & set(sets[2 * k + 1]))
        (kept if same >= 0.8 * (2 * n - same) else gone).add(2 * k)
    rows = spark.createDataFrame(list(sets.items()), "lid bigint, grams array<int>").withColumn("bits", F.expr(lines._folded("grams")))
    pairs = spark.createDataFrame([(k, k + 1) for k in sets if k % 2 == 0], "a bigint, b bigint")
    left = {r.a for r in lines._possible(pairs, rows, 0.8).collect()}
    assert len(kept) > 70 and kept <= left and len(gone & left) < 0.2 * len(gone)


ITEMS = [(1, " ".join(PROSE.split()[3:20])), (2, "seven wizards! MIX, very potent brews (in) old"), (3, None), (4, ""), (5, "one"), (6, "words that occur in no document of all these here"), (1, " ".join(PROSE.split()[3:20])), (7, "an item of two texts whose other one is long and in no document " * 3), (7, " ".join(PROSE.split()[1:18]))]


def brute_leaks(texts, items):
    fold = str.maketrans(*("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    from resultlake.llm.words import PARTING

    def sets(t):
        w = [x for x in (t or "").translate(fold).translate({ord(c): " " for c in PARTING}).split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    return sorted({(i, k) for i, t in texts for k, s in items if sets(s) and len(sets(t) & sets(s)) >= 0.8 * len(sets(s))}, key=repr)


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(decontaminate.leaks(docs, items), "doc_id", "item_id") == brute_leaks(TEXTS, ITEMS)
    bad = {i for i, _ in brute_leaks(TEXTS, ITEMS)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in TEXTS if i not in bad), key=repr)
    clash = docs.withColumn("__key", F.lit("mine")).limit(1)
    assert clash.columns == decontaminate.clean(clash, items.limit(0)).columns == simhash.distinct(clash).columns
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(TEXTS)


def test_contexts_are_whole(monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 4)
    pairs = [1] * 3 + [2] * 9 + [3] * 2 + [4] + [5] * 7
    t = pa.table({"key": range(len(pairs)), "n": [1] * len(pairs), "pair": pairs})
    for size in (1, 2, 3, 5, 50):
        got = [sorted(set(part.column("pair").to_pylist())) for _, _, part in lm._by_context(t.to_batches(max_chunksize=size))]
        assert sum(got, []) == [1, 2, 3, 4, 5]
        assert sum(part.num_rows for _, _, part in lm._by_context(t.to_batches(max_chunksize=size))) == len(pairs)


def test_counts_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 1000)
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), 100_000)) for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 3 > 0 for k in range(12)])], ["text", "train"])
    got = [b for b in lm._counted([batch]) if b.column(0)[0].as_py() == lm.GRAM]
    data, off = shared.buffers(batch.column(0))
    size = [len(lm.grams(shared.Words(data, off, k, k + 1))[0]) for k in range(12)]
    assert len(got) > 3 and max(b.num_rows for b in got) <= lm.FLUSH + shared.CHUNK_BYTES
    assert sum(sum(b.column(3).to_pylist()) for b in got) == sum(size)
    assert sum(sum(b.column(2).to_pylist()) for b in got) == sum(n for k, n in enumerate(size) if k % 3)


def test_context_tree_weighting_is_the_sequential_one():
    """The frozen probability of a next byte is the ratio of weighted probabilities of the counts."""
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ab "), 60)) + " abba"
    w = shared.Words(*shared.buffers(pa.array([text])), 0, 1)
    train, n = np.unique(lm.grams(w)[0], return_counts=True)

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(counts, path, level, prefix):
        at = {}
        for g, c in counts.items():
            context = g >> 8
            if all(context >> 8 * k & 255 == path[k] for k in range(len(path))) and (g & 255) >> (8 - level) == prefix:
                at[g] = c
        ones = sum(c for g, c in at.items() if g >> (7 - level) & 1)
        own = block(sum(at.values()) - ones, ones)
        if len(path) == lm.DEPTH:
            return own
        below = sum(whole(at, [*path, nxt], level, prefix) for nxt in {g >> 8 >> 8 * len(path) & 255 for g in at})
        return float(np.logaddexp(own, below) - math.log(2))

    counts = dict(zip(train.tolist(), n.tolist(), strict=True))
    probe = [int(train[3]), int(train[-1]), int(train[0]) & ~255 | 99]
    want = []
    for g in probe:
        p = 0.0
        for level in range(8):
            more = dict(counts)
            more[g] = more.get(g, 0) + 1
            prefix = (g & 255) >> (8 - level)
            p += (whole(more, [], level, prefix) - whole(counts, [], level, prefix)) / math.log(10)
        want.append(p)
    key = np.array(sorted({*train.tolist(), *probe}))
    count = np.array([counts.get(int(k), 0) for k in key], float)
    top = []
    for level in range(8):
        found, _ = lm._nodes(key, count, level)
        ids, _, n0, n1 = found[2]
        above, of = np.unique(lm._parent(level, ids), return_inverse=True)
        top.append((above, *lm._upper(level, above, *(np.bincount(of, v) for v in (lm._weighted(found)[0][2], n0, n1)))))
    got = dict(zip(key.tolist(), lm._log_probabilities(key, count, top).tolist(), strict=True))
    assert [got[g] for g in probe] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("hot", [(lm.HOT_GRAMS, lm.HOT_WORDS), (8, 2)])
def test_lm_scores(docs, none, monkeypatch, hot):
    monkeypatch.setattr(lm, "FLUSH", lm.FLUSH if hot[0] > 8 else 100)
    monkeypatch.setattr(lm, "HOT_GRAMS", hot[0])
    monkeypatch.setattr(lm, "HOT_WORDS", hot[1])
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    model = lm.fit(docs, train)
    counts, texts = Counter(), 0
    for i, t in TEXTS:
        if i is None or i % 3:
            counts.update(words(t))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    assert (model.tokens, model.distinct) == (n, v)
    want = []
    for i, t in TEXTS:
        ws = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((texts + 1) / (n + v + 1))
        want.append((i, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, round(base, 6)))
    got = lm.score(docs, model).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r.score for r in got}
    assert all(s < 0 for s in by.values()) and by[0] == pytest.approx(by[1]) and by[3] == pytest.approx(by[4])
    assert lm.score(none, lm.fit(none)).count() == 0


def labelled(spark):
    rng = np.random.default_rng(7)
    calm, rude = [f"calm{i}" for i in range(300)], ["moron", "trash", "scum"]
    rows = []
    for i in range(600):
        w = rng.choice(calm, 80).tolist()
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(0, 80))] = str(rng.choice(rude))
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity(spark, docs, none):
    rows = labelled(spark)
    model = toxicity.fit(rows, rows.where("doc_id < 450").select("doc_id", "toxic"))
    scored = toxicity.score(rows, model).where("doc_id >= 450")
    assert scored.where("(toxicity >= 0.5) = (toxic = 1)").count() >= 145
    odd = toxicity.score(docs, model)
    assert odd.count() == len(TEXTS) and dict(odd.dtypes)["toxicity"] == "double" and odd.where("toxicity < 0 OR toxicity > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(rows, rows.limit(0).select("doc_id", "toxic"))).where("toxicity <> 0").count() == 0


def test_toxicity_windows_cover_every_word():
    counts = np.array([0, 1, 24, 25, 100])
    at, doc = toxicity.windows(counts)
    first = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        assert set(at[doc == k][at[doc == k] >= 0].tolist()) == set(range(first[k], first[k] + n))


def test_toxicity_trains_on_what_it_scores():
    text = "cat internationalisation-of-things moronic a " + "x" * 40 + " żółw"
    w = shared.Words(*shared.buffers(pa.array([text, "one more text with a cat"])), 0, 2)
    p = toxicity._start(np.random.default_rng(1))
    p["C"], p["E"] = (np.random.default_rng(k).normal(size=p[n].shape).astype(np.float32) for k, n in ((2, "C"), (3, "E")))
    a = np.arange(toxicity.EVIDENCE_BUCKETS) % 7
    y = np.array([1, 0])
    rows = toxicity._picked(w, y, a, a + 3, 0.4, np.array([10, 11]), p)
    data = toxicity._Examples(pa.Table.from_batches([rows]))
    own = y[w.doc]
    e = toxicity._log_odds(a[toxicity._bucket(w)] - own, (a + 3)[toxicity._bucket(w)] - (1 - own), 0.4)
    want = toxicity.Model(None, p, 0.4).word_inputs(w, e)
    x = data.inputs(p, np.array([0, 1]))
    assert x[0, :6] == pytest.approx(want[:6], abs=1e-5) and x[1, :6] == pytest.approx(want[6:12], abs=1e-5) and not x[0, 6:].any()
    # gradients of the tables against differences
    dx = np.random.default_rng(4).normal(size=x.shape).astype(np.float32)
    got = data.gradients(np.array([0, 1]), dx)
    for name, at in (("C", (int(data.tri[20]), 2)), ("E", (int(data.bucket[3]), 1))):
        up = {**p, name: p[name].copy()}
        up[name][at] += 1e-2
        assert got[name][at] == pytest.approx(((data.inputs(up, np.array([0, 1])) - x) * dx).sum() / 1e-2, rel=1e-2, abs=1e-3)


def test_toxicity_gradient():
    rng = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(rng).items()}
    x = rng.normal(size=(5, toxicity.WINDOW, 1 + toxicity.WORD_DIM + toxicity.CHAR_DIM))
    mask = np.arange(toxicity.WINDOW) < np.array([[3], [24], [10], [1], [24]])
    y = np.array([1, 0, 1, 0, 1], float)

    def loss(p, x):
        g = {s: x @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}
        z = toxicity._forward(p, lambda s, t: g[s][:, t], mask)[0].astype(float)
        return np.logaddexp(0, np.where(y == 1, -z, z)).mean()

    grads, dx = toxicity._gradient(p, x, mask, y)
    for name in ("Wf", "Ub", "af", "ob", "bf", "c"):
        at = tuple(int(rng.integers(0, n)) for n in p[name].shape)
        more, less = ({**p, name: p[name].copy()} for _ in range(2))
        more[name][at] += 1e-3
        less[name][at] -= 1e-3
        assert grads[name][at] == pytest.approx((loss(more, x) - loss(less, x)) / 2e-3, abs=2e-4)
    up, down = x.copy(), x.copy()
    up[1, 5, 2] += 1e-3
    down[1, 5, 2] -= 1e-3
    assert dx[1, 5, 2] == pytest.approx((loss(p, up) - loss(p, down)) / 2e-3, abs=2e-4)


def test_quality(spark, docs, none):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(500):
        g = i % 3
        w = rng.choice([f"w{k}" for k in range(200)], 60).tolist() + [["bad", "poor"], ["fair"], ["fine", "great"]][g] * 3
        rows.append((i, " ".join(w) + (" ### $$$" if g == 0 else ""), g))
    rows = spark.createDataFrame(rows, "doc_id bigint, text string, rating int")
    model = quality.fit(rows, rows.where("doc_id < 400").selectExpr("doc_id", "rating AS grade"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    scored = quality.score(rows, model).where("doc_id >= 400")
    assert scored.where("grade = rating").count() >= 85
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.expected_grade <= 2 and r.tails[0] >= r.tails[1] for r in odd)
    assert quality.score(none, model).count() == 0
    assert quality.score(docs, quality.fit(rows, rows.limit(0).selectExpr("doc_id", "rating AS grade"))).first().tails == [0.5]


def test_a_very_long_text(spark, vocabulary):
    """Longer than a vectorised step many times over, beside a short one."""
    rng = np.random.default_rng(12)
    vocab = np.array([f"w{k}{'xyz'[k % 3] * (k % 7)}" for k in range(5000)])
    text = " ".join(rng.choice(vocab, 250_000))
    assert len(text) > 7 * shared.CHUNK_BYTES
    rows = spark.createDataFrame([(1, text), (2, "short " + text[:50])], "doc_id bigint, text string")
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(rows).collect()} == {1: fp(text), 2: fp("short " + text[:50])}
    ids = {r.doc_id: bytes(r.ids) for r in bpe.encode(rows, *vocabulary).collect()}
    assert ids[1] == np.array(bpe.encoding(*vocabulary).encode_ordinary(text), "<u4").tobytes()
    assert {r.doc_id: r.n_chars for r in fingerprint.with_next(rows).collect()}[1] == len(text)
    scored = {r.doc_id: r for r in lm.score(rows, lm.fit(rows)).collect()}
    assert scored[1].n_tokens == 250_001 and scored[1].n_bytes == len(text) + 1
    assert {r.doc_id: bytes(r.kept).decode() for r in suffix.dedup(rows).collect()} == {1: text, 2: "short " + text[:50]}
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(rows, toxicity.fit(rows, labels)).where("toxicity BETWEEN 0 AND 1").count() == 2


def test_queries_over_the_smallest_tables(spark):
    from resultlake.llm.queries import ORACLE, QUERIES

    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op1_fingerprints", "op2_quality", "op3_token_counts", "op4_bpe", "op5_line_dedup", "op6_suffix_dedup", "op7_simhash", "op8_ctw_scores", "op9_toxicity"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == n, name
    assert set(ORACLE) <= set(QUERIES)


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, shared.stage(stage(spark, docs, folder))
        seen[name] = before, docs
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["near-duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    root = grouped(sorted({fp(t) for t in texts.values()}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in texts.items():
        least[root[fp(t)]] = min(i, least.get(root[fp(t)], i))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["bpe"]
    encode = bpe.encoding(*bpe.vocabulary_file(spark)).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in after.collect()} == {r.doc_id: len(encode(r.text)) for r in before.collect()}
    before, after = seen["line dedup"]
    root = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    left = Counter(root[m] for r in after.collect() for line in r.text.split("\n") if (m := line.strip(" ").lower()))
    assert set(left) == set(root.values()) and max(left.values()) == 1




def test_toxicity_windows_picked_again_count_once():
    rows = [(2, 0, b"w", b"e", b"s", b"t"), (1, 1, b"x", b"e", b"s", b"t"), (2, 1, b"w", b"e", b"s", b"t"), (2, 0, b"w", b"e", b"s", b"a"), (1, 1, b"x", b"e", b"s", b"t")]
    table = pa.Table.from_pylist([dict(zip(toxicity._PICKED, (r[0], r[1], r[2], r[3], r[4], r[5]), strict=True)) for r in rows])
    twice = pa.concat_tables([table, table])
    assert [tuple(r.values()) for r in toxicity._once(twice).to_pylist()] == [rows[1], rows[3], rows[2]]
    assert toxicity._once(table.slice(0, 1)).num_rows == 1
