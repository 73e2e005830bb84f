"""Keyed state over event streams, and the batch twins that results are checked against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scans


def events(frame: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with zone, which watermarks need."""
    return frame.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(frame: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling windows; late rows count until the watermark."""
    rows = events(frame)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(frame: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions parted by ``gap``."""
    rows = events(frame)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def ledger(frame: DataFrame, late: str = "1 day") -> DataFrame:
    """Events whose id is new; in a stream, ids are remembered for the watermark."""
    rows = events(frame)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def daily_distinct(frame: DataFrame) -> DataFrame:
    """(user_id, event_type, day): an observation counts once a UTC day."""
    return events(frame).select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()


def rate_delay(frame: DataFrame, least_ms: int = 1500) -> DataFrame:
    """With delay_ms that a request must wait after the one before it of the same key."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    apart = (F.unix_micros("ts") - F.unix_micros(before)) / 1000.0
    return events(frame).withColumn("delay_ms", F.greatest(F.lit(0.0), F.coalesce(least_ms - apart, F.lit(0.0))))


def cooldown(outcomes: DataFrame, threshold: int = 3, hold_s: float = 300.0) -> DataFrame:
    """(key, fails, cooled_until, trips) after all outcomes (key, at double seconds, id, ok) in order.

    Failures add up; at ``threshold`` the key cools for ``hold_s`` and the count restarts; success
    clears both.

    A history is folded in pieces: what a piece does to each count of failures it may begin with is a
    table of ``threshold`` rows, and tables compose.  A null ``ok`` is a failure.
    """
    start = F.transform(F.sequence(F.lit(0), F.lit(threshold - 1)), lambda f: F.struct(f.alias("fails"), F.lit(None).cast("double").alias("until"), F.lit(0).cast("bigint").alias("trips")))

    def step(table, e):
        def of(s):
            trip = ~e["ok"] & (s["fails"] + 1 >= threshold)
            return F.struct(
                F.when(e["ok"] | trip, 0).otherwise(s["fails"] + 1).alias("fails"), F.when(e["ok"], 0.0).when(trip, e["at"] + hold_s).otherwise(s["until"]).alias("until"), (s["trips"] + trip.cast("bigint")).alias("trips")
            )

        return F.transform(table, of)

    def then(first, second):
        def of(s):
            t = F.get(second, s["fails"])
            return F.struct(t["fails"].alias("fails"), F.coalesce(t["until"], s["until"]).alias("until"), (s["trips"] + t["trips"]).alias("trips"))

        return F.transform(first, of)

    dealt = scans.pieces(outcomes.select("key", F.col("at").cast("double").alias("at"), "id", F.coalesce("ok", F.lit(False)).alias("ok")), ["key"], ["at", "id"])
    folded = dealt.groupBy("key", "piece").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "id", "ok"))), start, step).alias("map"))
    done = scans.composed(folded, ["key"], then).select("key", F.get("map", 0).alias("s"))
    return done.select("key", F.col("s.fails").alias("fails"), F.coalesce("s.until", F.lit(0.0)).alias("cooled_until"), F.col("s.trips").cast("int").alias("trips"))


class _Cooling:
    """State of one key: (fails, cooled_until); emits a row whenever a key starts to cool."""

    def __init__(self, threshold: int, hold_s: float):
        self.threshold, self.hold_s = threshold, hold_s

    def __call__(self, key, frames, state):
        fails, until = state.get if state.exists else (0, 0.0)
        trips = []
        # a key's rows of a trigger come in several frames, which aren't in order among each other
        for r in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples(index=False):
            if r.ok:
                fails, until = 0, 0.0
                continue
            fails += 1
            if fails >= self.threshold:
                fails, until = 0, r.at + self.hold_s
                trips.append((key[0], r.at, until))
        state.update((fails, until))
        yield pd.DataFrame(trips, columns=["key", "at", "cooled_until"])


def cooling_stream(outcomes: DataFrame, threshold: int = 3, hold_s: float = 300.0) -> DataFrame:
    """Stream of (key, at, cooled_until) from a stream of outcomes (key, at, id, ok)."""
    return outcomes.groupBy("key").applyInPandasWithState(_Cooling(threshold, hold_s), "key string, at double, cooled_until double", "fails int, until double", "append", "NoTimeout")


def cached(requests: DataFrame, cache: DataFrame, ttl_s: float) -> DataFrame:
    """Requests (key, at) with the newest cached value saved within ``ttl_s`` before; null for a miss.

    Of saves at one time the greatest value counts; an as-of join in pieces (``scans.as_of``).
    """
    saved = cache.select("key", F.col("saved_at").alias("at"), "value")
    found = scans.as_of(requests, saved, "value", name="__found")
    return found.withColumn("value", F.when(F.col("at") - F.col("__found.at") < ttl_s, F.col("__found.value"))).drop("__found")
