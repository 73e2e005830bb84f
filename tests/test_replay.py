"""The stateful stream gives the batch result whatever the order of its files."""

import random

import pytest
from pyspark.sql import functions as F

from resultlake.plans import measured
from resultlake.streaming import replay

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "key string, ts timestamp, id bigint, weight double, label double"


@pytest.fixture
def lists_and_timers(spark):
    before = spark.conf.get(replay.PROVIDER_KEY)
    spark.conf.set(replay.PROVIDER_KEY, replay.PROVIDER)
    yield
    spark.conf.set(replay.PROVIDER_KEY, before)


def test_outcomes_against_a_walk(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(200), i, 1.0, rng.choice([None, None, 0.9, 0.1])) for i in range(200)] + [(None, 5, 900, 1.0, None), ("alone", 5, 901, 1.0, None)]
    want = set()
    for key, at, id_, _, label in rows:
        later = sorted((t, i) for k, t, i, _, x in rows if k == key and key is not None and x is not None and at <= t <= at + 10)
        if label is None and later:
            want.add((id_, later[0][1]))
    frame = spark.createDataFrame(rows, "key string, at bigint, id bigint, weight double, label double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got = [(r.id, r.label_id) for r in replay.outcomes(frame, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("order", [0, 1, 2])
def test_a_stream_in_any_order_of_files(spark, tmp_path, lists_and_timers, order):
    wait = 6 * 3600
    events = measured.evidence_events(spark, FOLDER)
    span = events.agg((F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).alias("s"), F.max("ts").alias("last")).first()
    # one that comes last and closes every window
    flush = spark.createDataFrame([("flush",)], "key string").select("key", (F.lit(span["last"]) + F.expr(f"INTERVAL {2 * span['s'] + 3 * wait} SECONDS")).alias("ts"), F.lit(-1).cast("bigint").alias("id"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("label"))
    parts = [events.where(F.expr(f"pmod(xxhash64(id), 3) = {k}")) for k in range(3)]
    for nth, part in enumerate([*(parts[(k + order) % 3] for k in range(3)), flush]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{nth}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = replay.outcomes_stream(stream, wait, int(span["s"]) + wait)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "id", "label_id", "label").collect()))
    want = sorted(map(tuple, replay.outcomes(events, wait).select("key", "id", "label_id", "label").collect()))
    assert got == want and len(got) > 20
