"""Folders by key: filters reach the listing, failed and repeated attempts leave the same rows."""

import pytest
from pyspark.sql import functions as F

from resultlake.plans import roundtrip
from resultlake.sources import stored

FOLDER = "/root/testdata/sf0.001"


def test_engine_and_time_are_pushed_to_the_scan(spark, tmp_path):
    at = str(tmp_path / "pages")
    stored.replace(roundtrip.stored_pages(spark, FOLDER), at, "engine", "day")
    found = stored.pages(spark, at, ["bing", "searx"], "2026-01-03", "2026-01-20")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
    assert "engine" in pushed and "day" in pushed and ">=" in pushed and "<=" in pushed
    node = found._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    listed = node.selectedPartitions().toPartitionArray()
    assert 0 < len(listed) < spark.read.parquet(at).select("engine", "day").distinct().count()
    every = stored.pages(spark, at)
    assert every.count() == 20 and stored.pages(spark, at, []).count() == 0
    assert found.count() == every.where("engine IN ('bing', 'searx') AND day BETWEEN '2026-01-03' AND '2026-01-20'").count() > 0


def test_failed_and_repeated_attempts(spark, tmp_path):
    at = str(tmp_path / "docs")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source")
    stored.replace(docs, at, "source")
    rows = lambda: sorted(map(tuple, spark.read.parquet(at).select("doc_id", "source").collect()))
    whole = rows()
    broken = docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, F.raise_error("lost")).otherwise(F.col("doc_id")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        stored.replace(broken, at, "source")
    assert rows() == whole
    stored.replace(docs.where("source = 'src0'"), at, "source")
    stored.replace(docs, at, "source")
    assert rows() == whole and len(whole) == docs.count()
    batches = str(tmp_path / "batches")
    for k in (0, 1, 1):
        stored.append_once(docs.where(F.col("doc_id") % 2 == k), batches, str(k))
    assert spark.read.parquet(batches).count() == docs.count()
    stored.append_once(docs.limit(0), batches, "1")
    assert spark.read.parquet(batches).count() == docs.count()


def test_days_and_engines_that_are_null(spark, tmp_path):
    at = str(tmp_path / "odd")
    odd = spark.createDataFrame([(1, "u", None, "bing", None), (2, None, "x", None, None)], "page_id bigint, url string, html string, engine string, day string").withColumn("day", F.col("day").cast("date"))
    stored.replace(odd, at, "engine", "day")
    assert stored.pages(spark, at).count() == 2 and stored.pages(spark, at, ["bing"]).count() == 1 and stored.pages(spark, at, since="2026-01-01").count() == 0
