"""Physical plans: what the scan reads, and where Python runs."""

import re

from pyspark.sql import functions as F

from resultlake.operators import cluster, scans
from resultlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def read(text):
    return {tuple(sorted(c.split(":")[0] for c in m.split(","))) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)}


def test_scans_read_only_the_columns_used(spark):
    assert read(plan(spark, "url_normalize_pages")) == {("page_id", "url")}
    assert read(plan(spark, "body_regex")) == {("html", "page_id")}
    assert read(plan(spark, "daily_dedupe")) == {("event_type", "ts", "user_id")}


def test_filters_reach_the_scan(spark, monkeypatch):
    # histories are written in pieces: the job that reads the events is the one that deals them
    dealt, pieces = [], scans.pieces
    monkeypatch.setattr(scans, "pieces", lambda rows, *how: dealt.append(rows) or pieces(rows, *how))
    plan(spark, "rep_search_fold")
    assert "EqualTo(event_type,view)" in dealt[0]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan(spark, "rep_discounts")


def test_scalar_queries_stay_in_the_jvm(spark):
    for name in ("detect_flags", "content_evidence", "merge_dedupe", "bayes_predict", "rep_scores", "pick_date_pages", "cluster_score", "cooldown"):
        assert not re.search("Python|Pandas|Arrow", plan(spark, name)), name


def test_merging_shuffles_once_for_ranks_and_once_for_keys(spark):
    text = plan(spark, "merge_dedupe")
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 4 and "CartesianProduct" not in text


def test_singleton_buckets_read_every_vector(spark):
    got = catalog.QUERIES["singleton_buckets"](spark, FOLDER).toPandas()
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id").toPandas()
    assert sorted(got["idx"]) == sorted(vectors["vec_id"]) and len(vectors) > 200
    assert got.groupby("query_id")["idx"].nunique().max() <= 150


def test_search_parses_a_page_once(spark, monkeypatch):
    read, table = spark.sparkContext.accumulator(0), catalog.tables.table

    def seen(_):
        read.add(1)
        return True

    mark = F.udf(seen, "boolean").asNondeterministic()
    monkeypatch.setattr(catalog.tables, "table", lambda *of: table(*of).where(mark("page_id")))
    catalog.QUERIES["search"](spark, FOLDER).collect()
    assert read.value == table(spark, FOLDER, "pages").count()


def test_reprints_pair_results_of_a_passage_once(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(1, i, f"title {i}", f"{passage} {i}", [1.0, 0.0] if i % 2 else [0.8, 0.6]) for i in range(6)]
    rows = spark.createDataFrame(rows, "query_id bigint, idx bigint, title string, desc string, vec array<double>")
    found = cluster.reprints(rows)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0), (1, 3, 0), (1, 5, 0)}
    # pairs come from lists of results, not from a join of runs with themselves
    assert not re.search(r"\[query_id#\d+L, run#\d+L\], \[query_id#\d+L, run#\d+L\], Inner", found._jdf.queryExecution().executedPlan().toString())
