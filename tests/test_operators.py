"""Operators on literal rows, streams against their batch twins, and queries against their SQL."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from resultlake.functions.dialect import SPARK
from resultlake.operators import cluster, evidence, grade, merge, pubdate, reputation
from resultlake.plans import catalog
from resultlake.sources import dom, serp
from resultlake.streaming import state

FOLDER = "/root/testdata/sf0.001"


def test_merge_keeps_first_by_url(spark):
    rows = [(1, "", "bing", 0, 1, "A", "https://a.com/1"), (1, "", "bing", 0, 2, "B", "https://www.a.com/1"), (1, "", "baidu", 1, 1, "C", "https://c.com/"), (1, "", "baidu", 1, 2, "A", "https://d.com/")]
    lists = spark.createDataFrame(rows, "query_id bigint, query string, src string, src_order int, pos int, title string, url string")
    got = [(r.title, r.src, r.source_rank, r.source_count) for r in merge.merged(lists).orderBy("idx").collect()]
    assert got == [("A", "bing", 1, 2), ("C", "baidu", 1, 2), ("A", "baidu", 2, 2)]


def test_redirects_of_results_that_share_a_url(spark):
    rows = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, "v")], "page_id int, url string")
    known = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", ""), (4, "v", None)], "page_id int, url string, target string")
    assert {(r.page_id, r.url) for r in merge.resolved(rows, known, "page_id").collect()} == {(1, "a"), (2, "b"), (3, "u"), (4, "v")}


def test_redirects_of_lists_go_by_page(spark, tmp_path):
    pages = spark.createDataFrame([(i, "https://a.example/same", f"<title>t{i}</title><p>x</p>") for i in range(12)] + [(3001, "https://a.example/same", "<title>t</title>")], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = __spark_entry__.queries()["redirects_of_lists"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLE["redirects_of_lists"]).fetchall())


def test_reputation_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    flags = F.array(F.lit("low:spam-desc"), F.lit("low:index-page"))
    assert one(reputation.contribution(F.lit(0.5), flags)) == pytest.approx(0.1)
    assert one(reputation.contribution(F.lit(0.001), F.array(F.lit("x")))) == 0.05
    assert [one(reputation.factor(F.lit(s), F.lit(10))) for s in (0.0, 0.5, 1.0, 0.8)] == pytest.approx([0.35, 1, 1.15, 1.15])
    assert one(reputation.factor(F.lit(0.0), F.lit(2))) == 1
    assert [one(reputation.badge(F.lit(s), F.lit(5))) for s in (0.82, 0.31, 0.5)] == ["✓[rep:0.82]", "⚠[rep:0.31]", "·[rep:0.50]"]
    assert one(reputation.decayed(F.lit(1.0), F.lit(29.0))) == 1 and one(reputation.decayed(F.lit(1.0), F.lit(120.0))) == 0.5
    weights = {r.token: r.x for r in reputation.feature_weights(spark.createDataFrame([(1, ["t:a", "t:b", "t:c", "t:d", "u:x", "d:y", "f:z"])], "id int, tokens array<string>")).collect()}
    assert weights == {"t:a": 0.25, "t:b": 0.25, "t:c": 0.25, "t:d": 0.25, "u:x": 1.0}


def test_ftrl_learns_the_sign():
    events = [{"at": i, "id": str(i), "label": float(i % 2), "confidence": 1.0, "tokens": ["t:good" if i % 2 else "t:bad"]} for i in range(60)]
    w = reputation.ftrl(events)
    assert w["t:good"] > 0.5 > -0.5 > w["t:bad"]


def test_grades(spark):
    rows = [(1, 0, 0.59, 0.5), (1, 1, 0.36, 0.5), (1, 2, 0.32, 0.5), (1, 3, 0.2, 0.5), (1, 4, None, 0.5)]
    c = spark.createDataFrame(rows, "query_id int, cluster_id int, sem_score double, text_score double")
    tiers = lambda mode: [r.tier for r in grade.graded(c, mode).orderBy("cluster_id").collect()]
    assert [r.grade for r in grade.graded(c).orderBy("cluster_id").collect()] == ["relevant", "edge", "edge", "irrelevant", "unscored"]
    assert tiers("balanced")[:4] == ["shown", "edge", "edge", "collapsed"]
    assert tiers("aggressive")[:4] == ["shown", "collapsed", "collapsed", "collapsed"] and set(tiers("conservative")) == {"shown"}


def test_leader_clustering():
    v = np.array([[1, 0], [0.8, 0.6], [0.1231, 0.9924]])
    assert [g.members for g in cluster.leaders(v, 0.42, 1.01)] == [[0, 1, 2]]
    v = np.array([[1, 0], [0.999, 0.0447], [0.7, 0.714], [-1, 0]])
    groups = cluster.leaders(v, 0.42, 0.99)
    assert groups[0].duplicates == [(1, 0)] and [g.members for g in groups] == [[0, 2], [3]]


def test_oversized_and_buckets():
    rng = np.random.default_rng(0)
    base = np.eye(8)[0] + rng.normal(0, 0.05, (14, 8))
    base[13] = np.eye(8)[0] * 0.5 + np.eye(8)[1]
    v = base / np.linalg.norm(base, axis=1, keepdims=True)
    parts = cluster.split_oversized([cluster.Group(range(14), v)], v, [set()] * 14)
    assert sorted(len(p.members) for p in parts) == [1, 13]
    three = cluster.split_oversized([cluster.Group(range(21), np.ones((21, 2)))], np.ones((21, 2)), [{f"c:主{i % 3}题"} for i in range(21)])
    assert sorted(len(p.members) for p in three) == [7, 7, 7]
    groups = [cluster.Group([i], v) for i in range(3)]
    assert cluster.bucket_singletons(groups[:2], v) == groups[:2]


def test_phrase_groups():
    assert cluster.phrase_groups({"a": {1, 2, 3}, "b": {2, 3}, "c": {7, 8}}) == [{1, 2, 3}, {7, 8}]


def test_bayes_needs_telling_tokens(spark):
    rows = [(i, [f"w{k}" for k in range(6)] if i < 12 else [f"g{k}" for k in range(6)], 0.2 if i < 12 else 0.82, 0.8) for i in range(42)]
    events = spark.createDataFrame(rows, "id int, tokens array<string>, label double, confidence double")
    model = evidence.bayes_fit(events.unionByName(events))
    got = {r.id: r.prob for r in evidence.bayes_predict(spark.createDataFrame([(1, [f"w{k}" for k in range(6)]), (2, [f"g{k}" for k in range(6)]), (3, ["w1"])], "id int, tokens array<string>"), model).collect()}
    assert got[1] > 0.7 and got[2] < 0.4 and 3 not in got


def test_bayes_deals_tokens_by_contents(spark, monkeypatch):
    monkeypatch.setattr(evidence, "DEALT", 3)
    model = spark.createDataFrame([(f"w{k}", 9.0, 1.0) for k in range(6)], "token string, good double, bad double")
    contents = spark.createDataFrame([(i, [f"w{k}" for k in range(6)]) for i in range(100)], "id int, tokens array<string>")
    told = evidence.bayes_predict(contents, model)
    assert told.count() == 100 and "34), REPARTITION_BY_NUM" in told._jdf.queryExecution().executedPlan().toString()


def test_date_model_update():
    w, b = pubdate.updated({"x": 0.0}, 0.0, [({"x": 1.0}, 1.0)], 0.1)
    assert w["x"] == pytest.approx(0.05) and b == pytest.approx(0.05)


def test_dom_survives_broken_markup():
    doc = dom.parse("<div><p>one<p>two<li>a<li class='x y' id=q>b</div></b><br/>tail")
    assert [clean.text() for clean in doc.all("li")] == ["a", "b"] and doc.one("li.x#q").text() == "b" and doc.one("div li[class^='x']") is not None
    assert dom.parse(None).all("a") == []


def test_unreadable_sources_give_no_rows():
    assert serp.results(None, "bing") == [] and serp.results("验证码", "baidu") == [] and serp.board("{", "baidu") == [] and serp.json_items("{", "hn") == []


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    key = lambda rows: sorted(map(tuple, rows))
    assert key(drained(state.windowed(stream, late="60 days").select("window_start", "event_type", "n"), "w", "complete").collect()) == key(state.windowed(events).select("window_start", "event_type", "n").collect())
    assert drained(state.ledger(stream, "60 days"), "l", "append").count() == events.select("event_id").distinct().count()
    outcomes = lambda e: e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    trips = {r.key: r["count"] for r in drained(state.cooling_stream(outcomes(stream), 2), "c", "append").groupBy("key").count().collect()}
    assert trips and trips == {r.key: r.trips for r in state.cooldown(outcomes(events), 2).where("trips > 0").collect()}


def test_cooldown(spark):
    rows = [("a", float(i), i, ok) for i, ok in enumerate([False, False, True, False, False, False])]
    r = state.cooldown(spark.createDataFrame(rows, "key string, at double, id int, ok boolean")).first()
    assert (r.fails, r.cooled_until, r.trips) == (0, 305.0, 1)


def _canon(frame):
    def show(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return "NULL"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _canon(got) == _canon(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry(spark):
    from resultlake.sources import registry

    conf = {"bing": {"label": "Bing", "aggregateWith": ["all"]}, "baidu": {"zhOnly": True, "pageLimit": 20}, "searx": {}, "hn": {"enOnly": True, "fallbacks": ["bing"]}}
    rows = {r.engine: r for r in registry.engines(spark, conf, {"hn": {"disabled": True}}, ["baidu"]).collect()}
    assert sorted(rows) == ["baidu", "bing", "searx"] and rows["baidu"].ord == 0 and rows["bing"].aggregate_with == ["baidu"]
    for bad in ({"a": {"x": 1}}, {"a": {"pageLimit": True}}, {"a": {"fallbacks": ["b"]}}):
        with pytest.raises(ValueError):
            registry.validated(bad)


def test_snapshots(spark, tmp_path):
    from resultlake.sources import registry

    for engine in ("bing", "sm"):
        (tmp_path / engine).mkdir()
        (tmp_path / engine / "q1.html").write_text(f"<p>{engine}</p>")
    spark.dataSource.register(registry.Snapshots)
    got = spark.read.format("snapshots").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("bing", "q1", "<p>bing</p>"), ("sm", "q1", "<p>sm</p>")]


def test_settings(tmp_path):
    from resultlake.config import settings

    (tmp_path / "s.json").write_text('{"limit": 50, "similarity": 0.5}')
    s = settings(str(tmp_path / "s.json"), {"RESULTLAKE_LIMIT": "60"}, rel_mode="aggressive")
    assert (s.limit, s.similarity, s.rel_mode) == (60, 0.5, "aggressive")
    for bad in ({"limit": 151}, {"unknown": 1}, {"rel_mode": "x"}):
        with pytest.raises(ValueError):
            settings(None, {}, **bad)


def test_article():
    from resultlake.sources import article

    page = "<title>T - Site</title><body><nav><a href=/>home</a></nav><div class='sidebar'>" + "<a href=x>link</a>" * 30 + "</div><div class=content><h1>Real title</h1>" + "<p>A sentence of the article, long enough to count for something. And one more.</p>" * 4 + "<ul><li>point</ul></div><footer>foot</footer>"
    title, body, md = article.article(page)
    assert title == "Real title" and body.startswith("Real title") and "foot" not in body and "link" not in body
    assert md.startswith("# Real title") and "- point" in md
    assert article.article(None) == ("", "", "")


def test_automaton_finds_longest_common_runs():
    import random

    from resultlake.operators.cluster import common_span

    def by_table(a, b):
        best, end, before = 0, 0, [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            row = [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else 0
                if row[j] > best:
                    best, end = row[j], i
            before = row
        return a[end - best : end]

    rng = random.Random(1)
    for letters in ("ab", "abc", "港口ab"):
        for _ in range(400):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2))
            assert common_span(a, b) == by_table(a, b), (a, b)


def test_measures_of_collapsed_bodies_equal_those_of_bodies(spark):
    """Structural evidence works sentence lengths out once, from the body without white space."""
    bodies = ["", None, " x　y \n\n", "立即咨询 免费\n试用。限时优惠!!扫码购买", "﻿Ａ句子 很长很长很长。 second sentence here! third; sentence? fourth\nfifth sentence\n" * 9, "免费免费咨询立即" * 30 + "。" * 5, "点击 购买 添加微信 优惠名额 咨询热线 " * 12]
    rows = spark.createDataFrame([(i, "second 句子 title", b) for i, b in enumerate(bodies)], "id int, title string, body string")
    got = evidence.structural(rows).orderBy("id").select("n", "promo", "repeated", "coverage", "sentences", "cv").collect()
    plain = rows.orderBy("id").select(*(F.expr(e).alias(k) for k, e in evidence.measures(SPARK, "title", "body").items())).collect()
    assert got == plain and max(r.promo for r in plain if r.promo) > 9
    assert "lengths" not in evidence.structural(rows).columns
    assert evidence.measures(SPARK, "title", "body", "flat")["sentences"] == SPARK.size("lengths")
