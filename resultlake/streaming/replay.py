"""Evidence that waits for its outcome: a stateful stream with timers and expiry, and its batch twin.

Evidence about a key takes the first label of that key that follows it within ``expiry``; evidence
that none follows is dropped.  The stream decides about a piece of evidence when the watermark has
passed its expiry, so files may come in any order within the watermark's delay, and state holds
no more than a key's last ``expiry`` and delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import scans

#: State stores that keep lists and timers need this provider: ``PROVIDER_KEY`` set to ``PROVIDER``.
PROVIDER_KEY, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id bigint, at bigint, weight double, label_id bigint, label_at bigint, label double"
HALF_LIFE_DAYS = 90.0


class _Waiting(StatefulProcessor):
    """State of one key: evidence that waits, and labels that evidence may still take; times in microseconds."""

    def __init__(self, expiry: int, keep: int):
        self.expiry, self.keep = expiry, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.evidence = handle.getListState("evidence", "at bigint, id bigint, weight double")
        self.labels = handle.getListState("labels", "at bigint, id bigint, label double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            told = pdf["label"].notna()
            if told.any():
                self.labels.appendList([(int(a), int(i), float(x)) for a, i, x in zip(pdf["at"][told], pdf["id"][told], pdf["label"][told], strict=True)])
            if (~told).any():
                new = [(int(a), int(i), float(x)) for a, i, x in zip(pdf["at"][~told], pdf["id"][~told], pdf["weight"][~told], strict=True)]
                self.evidence.appendList(new)
                for at in {a for a, _, _ in new}:
                    # the first millisecond by which every label in time has come
                    self.handle.registerTimer((at + self.expiry) // 1000 + 1)
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        labels = sorted(self.labels.get())
        due, waiting, out = [], [], []
        for e in self.evidence.get():
            (due if e[0] + self.expiry < now else waiting).append(e)
        for at, id_, weight in sorted(due):
            first = next((x for x in labels if at <= x[0] <= at + self.expiry), None)
            if first:
                out.append((key[0], id_, at, weight, first[1], first[0], first[2]))
        self.evidence.put(waiting) if waiting else self.evidence.clear()
        # late evidence may still ask for what lies within the delay
        kept = [x for x in labels if x[0] >= now - self.expiry - self.keep]
        self.labels.put(kept) if kept else self.labels.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def outcomes_stream(events: DataFrame, expiry_s: int, delay_s: int) -> DataFrame:
    """Stream of OUT from a stream (key, ts timestamp, id, weight, label): label null for evidence."""
    rows = events.withWatermark("ts", f"{delay_s} seconds").withColumn("at", F.unix_micros("ts"))
    waiting = _Waiting(expiry_s * 1_000_000, delay_s * 1_000_000)
    return rows.groupBy("key").transformWithStateInPandas(waiting, OUT, "Append", "EventTime")


def outcomes(events: DataFrame, expiry_s: int) -> DataFrame:
    """OUT of a table (key, ts, id, weight, label): an as-of join that looks ahead, in pieces."""
    rows = events.withColumn("at", F.unix_micros("ts"))
    back = (-F.col("at")).alias("back")
    labels = rows.where("label IS NOT NULL").select("key", back, F.struct((-F.col("id")).alias("order"), "id", "at", "label").alias("value"))
    found = scans.as_of(rows.where("label IS NULL").select("key", "id", "at", "weight", back), labels, "value", at="back")
    x = F.col("found.value")
    fresh = found.where(x["at"] - F.col("at") <= expiry_s * 1_000_000)
    return fresh.select("key", "id", "at", "weight", x["id"].alias("label_id"), x["at"].alias("label_at"), x["label"].alias("label"))


def snapshots(outcomes_: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(key, day, good, bad): weights of good and bad outcomes after each day that brought one, halved every ``half_life_days``.

    Sums grow at the pace of the half-life, so a day's snapshot is a multiple of a running sum of daily
    ones, and every outcome is added once.
    """
    day = F.to_date(F.timestamp_micros("label_at"))
    steps = F.datediff("day", F.lit("2024-01-01").cast("date")) / half_life_days
    daily = outcomes_.withColumn("day", day).groupBy("key", "day").agg(F.sum(F.when(F.col("label") > 0.6, F.col("weight")).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("label") < 0.4, F.col("weight")).otherwise(0.0)).alias("bad"))
    upto = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: (F.sum(F.col(c) * F.pow(F.lit(2.0), steps)).over(upto) * F.pow(F.lit(2.0), -steps)).alias(c)
    return daily.select("key", "day", running("good"), running("bad"))
