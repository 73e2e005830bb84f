"""Folds and as-of joins in pieces, against plain loops: a key with most rows, ties, nulls, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from resultlake.operators import reputation, scans
from resultlake.streaming import state


@pytest.fixture(params=[(40, 2), (40, 1000), (10**6, 1000)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", request.param[0])
    monkeypatch.setattr(scans, "FAN", request.param[1])
    return request.param


def observations(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        kind = rng.choice(["search", "content", "fetch", "select"])
        value = float(rng.random() < 0.5) if kind == "fetch" else rng.choice([0.0, 1.0, rng.random(), -3.0, 5.0])
        out.append((key, i, rng.randrange(50), kind, value))
    return out


def walked(rows):
    entries = {}
    for key, id_, at, kind, value in sorted(rows, key=lambda r: (r[2], r[1])):
        e = entries.setdefault(key, {"search": [0.5, 0], "content": [0.5, 0], "fetch": [0.5, 0], "select": [0.5, 0]})
        s, n = e[kind]
        n += 1
        if kind == "search":
            s = min(1.0, max(0.0, s + min(0.5, 1 / (1 + n * 0.12)) * (value - s)))
        elif kind == "content":
            s = 0.5 * s + 0.5 * value
        elif kind == "fetch":
            s = 0.5 * s + 0.5 * (0.95 if value > 0 else 0.1)
        e[kind] = [s, n]
    return {k: (round(e["search"][0], 9), e["search"][1], round(e["content"][0], 9), e["content"][1], round(e["fetch"][0], 9), e["fetch"][1], e["select"][1]) for k, e in entries.items()}


SCHEMA = "key string, id bigint, at bigint, kind string, value double"
MEASURES = ["search_score", "search_samples", "content_score", "content_samples", "availability_score", "availability_samples", "utility_samples"]


def test_reputation_folds_in_pieces(spark, sizes):
    rows = observations()
    frame = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(4)
    got = {r["key"]: tuple(round(r[m], 9) if "score" in m else r[m] for m in MEASURES) for r in reputation.learned(frame).collect()}
    assert got == walked(rows)
    assert reputation.learned(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_key_is_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 40)
    dealt = scans.pieces(spark.createDataFrame([("hot", i, i) for i in range(1000)], "key string, at bigint, id bigint"), ["key"], ["at", "id"])
    sizes = [r["count"] for r in dealt.groupBy("piece").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 200
    ends = dealt.groupBy("piece").agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy("piece").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_cooldown_tables_compose(spark, sizes, threshold):
    rng = random.Random(threshold)
    rows = [("hot" if rng.random() < 0.9 else f"k{i % 5}", float(rng.randrange(200)), i, rng.random() < 0.4) for i in range(500)]
    want = {}
    for key, at, _, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        fails, until, trips = want.get(key, (0, 0.0, 0))
        if ok:
            fails, until = 0, 0.0
        elif fails + 1 >= threshold:
            fails, until, trips = 0, at + 300.0, trips + 1
        else:
            fails += 1
        want[key] = fails, until, trips
    frame = spark.createDataFrame(rows, "key string, at double, id bigint, ok boolean").repartition(3)
    assert {r["key"]: (r.fails, r.cooled_until, r.trips) for r in state.cooldown(frame, threshold).collect()} == want


def test_as_of_finds_the_newest_fact(spark, sizes):
    rng = random.Random(9)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    facts = [(key(), rng.choice([None, *range(100)]), rng.randrange(1000)) for _ in range(300)]
    asked = [(key(), rng.choice([None, *range(100)]), i, "x") for i in range(400)]
    newest = lambda k, at: max(((t, v) for f, t, v in facts if f == k and t is not None and t <= at), default=None) if k is not None and at is not None else None
    found = scans.as_of(spark.createDataFrame(asked, "key string, at bigint, id int, value string"), spark.createDataFrame(facts, "key string, at bigint, value int"), "value")
    assert found.columns == ["key", "at", "id", "value", "found"]
    assert {r.id: tuple(r.found) if r.found else None for r in found.collect()} == {i: newest(k, at) for k, at, i, _ in asked}
    none = spark.createDataFrame([], "key string, at bigint, value int")
    assert scans.as_of(none, none, "value").collect() == []


def test_standing_as_of_a_day(spark, sizes):
    """What a result sees is what a walk over the days before it gives."""
    rng = random.Random(7)
    day = 86_400_000_000
    rows = [(key, id_, rng.randrange(5 * day), kind, value) for key, id_, _, kind, value in observations(400)]
    asked = [(rng.choice(["hot", "a", "b", "never"]), rng.randrange(7 * day), i) for i in range(120)]
    got = reputation.standing_as_of(spark.createDataFrame(asked, "key string, at bigint, nth int"), spark.createDataFrame(rows, SCHEMA))
    for r in got.collect():
        before = [o for o in rows if o[0] == r["key"] and o[2] // day < r["at"] // day]
        want = walked(before).get(r["key"], (None, 0, None, 0, None, 0, 0))
        assert tuple(round(r[m], 9) if r[m] is not None and "score" in m else r[m] for m in MEASURES) == want
    last = {r["key"]: r for r in reputation.daily(spark.createDataFrame(rows, SCHEMA)).groupBy("key").agg(F.max_by(F.struct(*MEASURES), "day").alias("m")).collect()}
    assert {k: tuple(round(r.m[m], 9) if "score" in m else r.m[m] for m in MEASURES) for k, r in last.items()} == walked(rows)
