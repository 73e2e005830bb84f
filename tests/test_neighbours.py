"""The inverted file of vectors against all pairs: no link is lost, cells that hold most rows are blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resultlake.operators import embed, neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id bigint, v array<double>").repartition(3)


def brute(rows, every, low, high=2.0):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    return {(q, i) for q in unit for i in unit if q % every == 0 and i != q and low <= unit[q] @ unit[i] < high}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(500)]
    return rows + [(1000 + i, (np.ones(16) + rng.normal(size=16) * 0.3).tolist()) for i in range(300)]


@pytest.mark.parametrize("low,high", [(0.75, 0.94), (0.9, 2.0), (-1.0, 0.2)])
def test_links_equal_all_pairs(spark, monkeypatch, clustered, low, high):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "CELLS", 8)
    index = neighbours.Index(frame(spark, clustered))
    assert max(index.blocks) > 4
    got = [(r.qid, r.id) for r in index.within(F.col("id") % 10 == 0, low, high).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(clustered, 10, low, high)


def test_probes_leave_cells_out(spark, clustered):
    index = neighbours.Index(frame(spark, clustered))
    asked = index.rows.where("id % 10 = 0")
    assert index.probes(asked, 0.9).count() < 0.5 * asked.count() * len(index.centres)


def test_rows_that_are_not_vectors(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [2.0, 0.0]), (20, [1.0, 0.1])]
    index = neighbours.Index(frame(spark, odd))
    assert {(r.qid, r.id) for r in index.within(F.col("id") % 10 == 0, 0.9).collect()} == {(10, 11), (10, 20), (20, 10), (20, 11)}
    assert neighbours.Index(frame(spark, [])).within(F.col("id") % 10 == 0, 0.5).collect() == []


def test_projections_estimate_likeness(spark):
    """Cosines of projections stay within a few deviations of those of the weighted token sets."""
    rng = np.random.default_rng(8)
    words = [f"w{k}x" for k in range(400)]
    base = list(rng.choice(words, 120, replace=False))
    texts = [(i, " ".join(base[: 120 - 12 * i] + [f"own{i}n{k}" for k in range(12 * i)])) for i in range(9)] + [(50, None), (51, ""), (52, "..")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: np.array(r.v) for r in embed.projected(rows).collect()}
    assert set(got) == set(range(9))
    sets = {i: set(t.split()) for i, t in texts[:9]}
    df = {w: sum(w in s for s in sets.values()) for s in sets.values() for w in s}
    weight = lambda ws: sum(math.log(1 + 12 / df[w]) ** 2 for w in ws)
    for i in range(9):
        cosine = got[0] @ got[i] / np.linalg.norm(got[0]) / np.linalg.norm(got[i])
        assert abs(cosine - weight(sets[0] & sets[i]) / math.sqrt(weight(sets[0]) * weight(sets[i]))) < 0.35
    assert embed.projected(rows.limit(0)).collect() == []


def test_pairs_are_no_rows_of_a_join(spark, clustered):
    plan = neighbours.Index(frame(spark, clustered)).within(F.col("id") % 10 == 0, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") + plan.count("REPARTITION") <= 2


def test_queries_go_in_parts(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    for name in ("TILE", "WIDE", "PAIRS", "PROBES"):
        monkeypatch.setattr(neighbours, name, 11)
    got = [(r.qid, r.id) for r in neighbours.Index(frame(spark, clustered)).within(F.col("id") % 10 == 0, 0.75, 0.94).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(clustered, 10, 0.75, 0.94)


def test_rows_under_one_id_are_one_text(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, "delta alpha"), (None, "beta"), (3, None)], "id int, text string")
    got = {r.id: np.array(r.v) for r in embed.projected(rows).collect()}
    apart = {r.id: np.array(r.v) for r in embed.projected(spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta alpha"), (None, "beta"), (3, None)], "id int, text string")).collect()}
    assert set(got) == {1, 2, None} and all(np.allclose(got[k], apart[k]) for k in got)


def test_evidence_moves_only_texts_of_pairs(spark, monkeypatch):
    """Texts of pairs alone, bare and cut to what is compared; pairs without a text have no evidence."""
    told, real = [], neighbours.staged
    monkeypatch.setattr(neighbours, "staged", lambda df, name: told.append((name, out := real(df, name))) or out)
    passage = " ".join(f"word{k}" for k in range(900))
    rows = [(1, "a title of one text", passage + " tail"), (2, "a title of one text!", "x " * 9 + passage), (3, None, None), *((k, "other", "text " * 9) for k in range(4, 40))]
    pairs = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.8), (1, 99, 0.8)], "qid bigint, id bigint, sim double")
    got = neighbours.reprinted(pairs, spark.createDataFrame(rows, "id bigint, title string, desc string")).collect()
    assert {(r.qid, r.id): (r.near_title, r.near_desc) for r in got} == {(1, 2): (True, True), (1, 3): (False, False), (1, 99): (False, False)}
    held = {r.id: r.desc for name, df in told if name == "reprint-texts" for r in df.collect()}
    assert set(held) == {1, 2, 3} and len(held[1]) == 4096 and " " not in held[2]


def test_shared_runs_equal_plain_search(spark):
    """Around blocks of half a run's length no run is lost, wherever it lies; null stays null."""
    from resultlake.functions import text
    from resultlake.functions.dialect import SPARK

    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abé"), n))
    rows = [(draw(int(rng.integers(0, 40))), draw(int(rng.integers(0, 40))), int(rng.integers(1, 9))) for _ in range(400)]
    for k in range(60):  # a run of exactly n, at every offset
        n = 12 + k % 3
        run = draw(n)
        rows.append(("x" * k + run + "y" * 20, "z" * (60 - k) + run + "w" * 9, n))
        rows.append(("x" * k + run[:-1] + "y" * 20, "z" * (60 - k) + run[:-1] + "w" * 9, n))
    got = spark.createDataFrame(rows, "a string, b string, k int").selectExpr("a", "b", "k", f"{text.shares_run(SPARK, 'a', 'b', 'k')} AS got").collect()
    assert all(r.got == any(r.a[i : i + r.k] in r.b for i in range(len(r.a) - r.k + 1)) for r in got) and {r.got for r in got} == {True, False}
    nulls = spark.createDataFrame([(None, "abc"), ("abc", None)], "a string, b string").selectExpr(f"{text.shares_run(SPARK, 'a', 'b', '2')} AS got")
    assert [r.got for r in nulls.collect()] == [None, None]
