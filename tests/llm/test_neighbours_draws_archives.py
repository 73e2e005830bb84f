"""Hard negatives, importance resampling and WARC archives against brute force, with awkward rows."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resultlake.llm import hardneg, importance, shared, warc
from resultlake.llm.queries import ORACLE, QUERIES


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows, every, scale=256):
    """rows (id, label, vector): the contract, row by row."""
    sound = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = sorted({(i, lab, tuple(v)) for i, lab, v in sound}, key=repr)
    out = []
    for a, lab, v in sound:
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, l2) for i, l2, w in sound if i != a]
        for p, pid, _ in sorted((s, i, l2) for s, i, l2 in scores if l2 == lab)[:5]:
            fits = sorted((s, i) for s, i, l2 in scores if l2 != lab and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, lab, v in rows], "vec_id bigint, label int, embedding array<double>, id string, cell int").repartition(3)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    # clusters far apart, a vector that a third of the rows share, ties, odd rows; small blocks and groups
    monkeypatch.setattr(hardneg, "ROWS", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 8)
    monkeypatch.setattr(hardneg, "GROUP_ANCHORS", 8)
    monkeypatch.setattr(hardneg, "STEP_ANCHORS", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 6] + rng.normal(size=8) * 0.3).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, [1.0] * 8) for i in range(200)]
    rows += [(2000, None, [1.0] * 8), (2010, 1, None), (2020, 1, [1.0, None] + [0.0] * 6), (2030, 1, [math.nan] * 8), (2040, 2, [math.inf] * 8), (None, 1, [1.0] * 8), (2050, 0, [0.0] * 8), (2060, 1, [-1.0] * 8), (0, rows[0][1], rows[0][2])]
    got = rows_of(hardneg.mine(vectors(spark, rows), F.col("id") % 10 == 0))
    assert got == brute_negatives(rows, 10) and len(got) > 300


def test_bounds_leave_far_rows_out(spark, monkeypatch):
    """Tight clusters: a group of anchors is sent a part of the rows only, and nothing is lost."""
    monkeypatch.setattr(hardneg, "GROUP_ANCHORS", 8)
    rng = np.random.default_rng(6)
    centres = np.eye(8) * 100
    rows = [(i, int(i % 16 // 8), (centres[i % 8] + rng.normal(size=8) * 0.01 + (i % 16 // 8) * 0.5).tolist()) for i in range(800)]
    given = hardneg.prepared(vectors(spark, rows))
    placed, space = hardneg.assigned(given, 80)
    anchors = placed.where("id % 10 = 0").withColumn("akey", F.xxhash64("id", "label", "v"))
    histogram = hardneg.Histogram(placed, space)
    near = lambda b, to: (to - np.array([[histogram.within(x, to[i], 6)] for i, x in enumerate(b.column("label").to_pylist())]), to + np.array([[histogram.within(x, to[i], 6)] for i, x in enumerate(b.column("label").to_pylist())]))
    groups = hardneg.Groups(anchors, space, histogram, near)
    sent = groups.dealt(anchors, placed, space)[1].count()
    assert len(groups.anchors) == 4 and sent < 800 * len(groups.anchors) / 2
    assert rows_of(hardneg.mine(vectors(spark, rows), F.col("id") % 10 == 0)) == brute_negatives(rows, 10)


def test_hard_negatives_of_little(spark):
    anchor = F.col("id") % 10 == 0
    for rows in ([], [(0, 1, [1.0, 2.0])], [(1, 1, [1.0]), (2, 2, [2.0])], [(0, 1, []), (10, 1, [])], [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], [(0, 1, [1.0, 1.0]), (1, 1, [1.0]), (2, 2, [0.7])]):
        padded = [(i, lab, list(v) + [0.0] * (2 - len(v))) for i, lab, v in rows]
        assert rows_of(hardneg.mine(vectors(spark, rows), anchor)) == brute_negatives(padded, 10)
    huge = [(i, i % 2, [8e5 * (i + 1), 3e5]) for i in range(12)]  # beyond what single and double precision hold exactly
    assert rows_of(hardneg.mine(vectors(spark, huge), anchor)) == brute_negatives(huge, 10)
    with pytest.raises(ValueError):
        hardneg.mine(vectors(spark, [(0, 1, [1e9, 1e9])]), anchor)


# --- importance resampling -------------------------------------------------------------------


def brute_importance(docs, target, most=1, share=10, least=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    features = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = {}, {}
    for text, of in [(x, s) for _, x in docs] + [(x, t) for x in target]:
        for b in features(words(text)):
            of[b] = of.get(b, 0) + 1
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (S + 10000.0) / ((s.get(b, 0) + 1.0) * (T + 10000.0))))
    rows = []
    for i, text in docs:
        w = words(text)
        f = features(w)
        weight = sum(gain(b) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[5] = k
    return sorted((tuple(r) for r in rows), key=repr)


SENTENCE = "Alpha beta GAMMA 1234 delta-epsilon zeta éñ 中文 can't stop"


@pytest.mark.parametrize("most,share", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_importance_against_brute_force(spark, most, share):
    docs = [(i, " ".join([SENTENCE] * (1 + i % 7)) + f" word{i} " * (i % 40)) for i in range(60)] + [(100, None), (101, ""), (102, "!!!"), (103, "one"), (104, "a\x00b " * 30), (105, "long " * 50_000)]
    target = ["alpha beta target", None, "", "word3 word5 word7 " * 5]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, score string, n int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, goal, share=share, most=most)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute_importance(docs, target, most, share)


def test_importance_of_repeats_and_empty_tables(spark):
    goal = spark.createDataFrame([], "text string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(none, goal).collect() == []
    twice = [(1, SENTENCE * 5)] * 6 + [(None, SENTENCE * 5)] * 4
    frame = spark.createDataFrame(twice, "doc_id bigint, text string")
    got = importance.resample(frame, goal, share=50).collect()
    assert len(got) == 10 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert len({(r.doc_id, r.weight, r.score) for r in got}) == 2


# --- WARC ------------------------------------------------------------------------------------

TRAP = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:false>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\nafter"
PAGES = [
    (1, "https://a.example/x?y=1#z", "<p>one</p>"), (2, "https://b.example", "<p>same</p>"), (3, "http://b.example/two words\n", "<p>same</p>"), (4, None, "<p>same</p>"), (5, "u", None), (6, "v", ""), (7, "w", TRAP), (8, "w", TRAP), (9, "中文", "é 中文 😀\r\n\r\n\r\n\r\n"),
    (None, "no id", "<p>unnamed</p>"), (10, "x", "<p>twice</p>"), (10, "x", "<p>twice</p>"), (11, "big", "b" * 3_000_000), (12, "ends", "WARC/1."), (13, "ends", "x\r\n\r\nWARC/1."),
]


def brute_captures(pages, least=0):
    out = []
    for i, url, html in pages:
        raw = (html or "").encode()
        top = max((p[0], p[1] or "") for p in pages if (p[2] or "").encode() == raw and p[0] is not None) if i is not None else (i, url)
        again = len(raw) >= least and (i, url or "") != top
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top[0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,files", [(0, 1), (0, 4), (8, 2)])
def test_archives_hold_what_was_written(spark, least, files):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, id string, digest string").repartition(files)
    at = warc.write(pages, shared.shared_folder(spark), least_bytes=least)
    found = warc.captures(spark, at)
    got = warc.resolved(found)
    assert rows_of(got.drop("uri", "n_records")) == brute_captures(PAGES, least)
    assert {r.n_records for r in got.collect()} == {3}
    payloads = {(bytes(r.payload) if r.payload is not None else None) for r in found.collect()}
    assert payloads - {None} == {(h or "").encode() for _, _, h in PAGES}
    uris = {r.page_id: r.uri for r in got.collect()}
    assert uris[3] == "http://b.example/two%20words%0A" and uris[4] is None and uris[1] == "https://a.example/x?y=1#z"


def test_archives_that_others_wrote(spark, tmp_path):
    """Links from the response to its request and over it to metadata, other cases and orders of fields, gzip members."""
    import gzip

    def record(kind, name, block, *more):
        head = "\r\n".join([f"warc-type: {kind}", f"content-length: {len(block)}", f"Warc-Record-Id: {name}", *more])
        return f"WARC/1.0\r\n{head}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nWARC/1.0 is a format"
    parts = [
        record("warcinfo", "<i>", b"software: none\r\n"), record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "<r>", page, "WARC-Concurrent-To: <q>"), record("metadata", "<m>", b"fetchTimeMs: 1\r\n", "WARC-Concurrent-To: <q>"), record("response", "<alone>", b"\xff\xfe raw \x00 bytes"), record("metadata", "<stray>", b"x"),
    ]
    (tmp_path / "own.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r.capture.id: r for r in warc.captures(spark, str(tmp_path)).collect()}
    assert set(got) == {"<r>", "<alone>"}
    assert bytes(got["<r>"].payload) == b"body\r\n\r\nWARC/1.0 is a format" and got["<r>"].http.startswith("HTTP/1.1 200 OK")
    assert [x.id for x in got["<r>"].requests] == ["<q>"] and [x.id for x in got["<r>"].metadata] == ["<m>"]
    assert got["<alone>"].requests == [] and got["<alone>"].metadata == []


def test_common_archives_are_not_read_by_lines(spark, monkeypatch):
    monkeypatch.setattr(warc, "_walk", None)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for compression in ("gzip", "none"):
        at = warc.write(pages, shared.shared_folder(spark), compression=compression)
        assert warc.records(spark, at).count() == 3 * pages.count()


def test_an_empty_archive_and_split_files(spark, monkeypatch):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.resolved(warc.captures(spark, warc.write(none, shared.shared_folder(spark)))).collect() == []
    # one file read in many ranges, and links of keys that don't all fit the broadcast
    monkeypatch.setattr(warc, "HOT_KEYS", 2)
    many = [(i, f"https://h.example/{i}", f"<p>{i % 40 if i % 3 else 7}</p>" * 50) for i in range(300)]
    at = warc.write(spark.createDataFrame(many, none.schema).coalesce(1), shared.shared_folder(spark), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert spark.read.text(at).rdd.getNumPartitions() > 20
        for size in ("10000", "3000"):  # ranges that begin anywhere, within separators too
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows_of(warc.resolved(warc.captures(spark, at)).drop("uri", "n_records")) == brute_captures(many)
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{name}", value)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance", "op13_warc"])
def test_contract_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(ORACLE[name])
    order = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(order)
    assert rows_of(got.select(order)) == sorted(want.fetchall(), key=repr)


def test_best_takes_ties_by_id():
    scores = np.array([[3.0, 5, 5, 5, np.finfo(float).min], [1, 1, 1, 1, 1]])
    row, at = hardneg.best(scores, np.array([9, 8, 7, 6, 5]), 2)
    assert list(zip(row, at, strict=True)) == [(0, 3), (0, 2), (1, 4), (1, 3)]
    assert hardneg.matrix(pa.array([[1, 2], [3], []], pa.list_(pa.int16())), 2).tolist() == [[1, 2], [3, 0], [0, 0]]


# --- suffix dedup ----------------------------------------------------------------------------


def test_suffix_dedup_keeps_texts_that_a_polynomial_hash_confuses(spark):
    """Pairs around one common 64-byte gram whose differences vanish in any polynomial modulo 2^64."""
    from resultlake.llm import suffix

    signs = np.ones(1, int)
    for k in range(8):
        signs = np.r_[signs, -signs]
    change = np.zeros(736, int)
    for at, sign in ((0, 1), (64, -1), (384, -1), (448, 1)):
        change[at : at + 256] += sign * signs
    assert not change[320:384].any() and abs(change).max() == 2
    rng = np.random.default_rng(736)
    texts = []
    for _ in range(500):
        base = rng.integers(60, 100, 736)
        texts += ["".join(map(chr, base)), "".join(map(chr, base + 8 * change))]
    strings = [{t[i : i + 400] for i in range(337)} for t in texts]
    assert all(not (a & b) for a, b in zip(strings[::2], strings[1::2], strict=True))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert suffix.dedup(rows).where("n_removed > 0 OR n_spans > 0").count() == 0
