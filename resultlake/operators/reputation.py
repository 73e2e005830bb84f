"""Reputation of sites: score recurrences, decay, factors, and the learned cross-site prior."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, urls
from . import scans

LEAST_SAMPLES, STRENGTH, DECAY_FROM, DECAY_TO = 3, 1.6, 30, 90
RATE, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
PRIOR_FULL, PRIOR_LOW, PRIOR_HIGH = 3000, 0.15, 0.85
READY_SAMPLES, READY_CLASS = 30, 5


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def contribution(quality: Column, flags: Column) -> Column:
    spam = F.arrays_overlap(flags, F.array(F.lit("low:spam-title"), F.lit("low:spam-desc")))
    c = F.coalesce(quality, F.lit(0.5)) * F.when(spam, 0.4).otherwise(1.0)
    c = c * F.when(F.array_contains(flags, "low:index-page"), 0.5).otherwise(1.0) * F.when(F.array_contains(flags, "low:desc-empty"), 0.95).otherwise(1.0)
    return clamp(c, 0.05, 1.0)


def search_step(value: Column, nth: Column) -> Column:
    """Move of the search score by a key's nth contribution: the rate falls with the samples so far."""
    rate = F.least(F.lit(0.5), 1 / (1 + nth * 0.12))
    return scans.line(1 - rate, rate * value, 0.0, 1.0)


def halving_step(value: Column) -> Column:
    """Move half way to a contribution."""
    return scans.line(F.lit(0.5), 0.5 * value)


def effective(search: Column, content: Column, content_samples: Column) -> Column:
    s = F.coalesce(search, F.lit(0.5))
    return F.when(F.coalesce(content_samples, F.lit(0)) > 0, 0.7 * F.coalesce(content, F.lit(0.5)) + 0.3 * s).otherwise(s)


def decayed(score: Column, age_days: Column) -> Column:
    """Towards 0.5 between DECAY_FROM and DECAY_TO days."""
    t = clamp((age_days - DECAY_FROM) / float(DECAY_TO - DECAY_FROM), 0.0, 1.0)
    return F.when(age_days <= DECAY_FROM, score).otherwise(0.5 + (score - 0.5) * (1 - t))


def factor(score: Column, samples: Column) -> Column:
    return F.when(samples < LEAST_SAMPLES, 1.0).otherwise(clamp(1 + (score - 0.5) * STRENGTH, 0.35, 1.15))


def availability_factor(score: Column, samples: Column) -> Column:
    return F.when(F.coalesce(samples, F.lit(0)) < LEAST_SAMPLES, 1.0).otherwise(clamp(1 + (F.coalesce(score, F.lit(0.5)) - 0.5) * 0.5, 0.75, 1.05))


def utility_factor(samples: Column) -> Column:
    n = F.coalesce(samples, F.lit(0))
    return F.when(n < LEAST_SAMPLES, 1.0).otherwise(1 + 0.03 * F.least(F.lit(1.0), n / 5.0))


def badge(score: Column, samples: Column) -> Column:
    mark = F.when(score >= 0.65, "✓").when(score <= 0.35, "⚠").otherwise("·")
    return F.when(samples < LEAST_SAMPLES, "").otherwise(F.concat(mark, F.lit("[rep:"), F.format_string("%.2f", score), F.lit("]")))


def learned(observations: DataFrame) -> DataFrame:
    """Entries by key from observations (key, id, at, kind, value), in order of (at, id).

    kinds: search, content, fetch (value 1 or 0) and select.  Equal (key, kind, id) count once.  Scores
    are folded in pieces (``scans``), so a key's history never meets in one place; a kind without
    observations has score 0.5, a null key is a key, a null value moves nothing but counts.
    """
    moves = F.when(F.col("kind") == "fetch", F.when(F.col("value") > 0, 0.95).otherwise(0.1)).otherwise(F.col("value"))
    once = observations.dropDuplicates(["key", "kind", "id"]).select("key", "kind", "at", "id", moves.cast("double").alias("value"))
    dealt = scans.pieces(once, ["key", "kind"], ["at", "id"])
    of_piece = dealt.groupBy("key", "kind", "piece").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "select", F.struct("at", "id", "value")))), lambda e: e["value"]).alias("values"),
    )
    placed = scans.counted_before(of_piece, ["key", "kind"])
    still = scans.line(F.lit(1.0), F.lit(0.0))
    steps = F.transform("values", lambda v, i: F.when(v.isNull(), still).when(F.col("kind") == "search", search_step(v, F.col("before") + i + 1)).otherwise(halving_step(v)))
    folded = placed.select("key", "kind", "piece", F.aggregate(steps, still, scans.line_then).alias("map"))
    scores = scans.composed(folded, ["key", "kind"], scans.line_then).select("key", "kind", scans.line_at(F.col("map"), 0.5).alias("score"))
    counts = of_piece.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    both = counts.join(scores.withColumnsRenamed({"key": "k", "kind": "d"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("kind") == F.col("d")))
    of = lambda kind, c, other: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(other))
    return both.groupBy("key").agg(
        of("search", "score", 0.5).alias("search_score"), of("search", "n", 0).cast("int").alias("search_samples"), of("content", "score", 0.5).alias("content_score"), of("content", "n", 0).cast("int").alias("content_samples"),
        of("fetch", "score", 0.5).alias("availability_score"), of("fetch", "n", 0).cast("int").alias("availability_samples"), of("select", "n", 0).cast("int").alias("utility_samples"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )


STANDING = ["search_score", "search_samples", "content_score", "content_samples", "availability_score", "availability_samples", "utility_samples"]


def daily(observations: DataFrame) -> DataFrame:
    """(key, day, STANDING...): how a key stood at the end of each UTC day on which it was observed.

    ``observations`` as in ``learned``, ``at`` in microseconds.  A day's observations are folded in
    pieces into one map, a key's days are run through in order: these are as many as the calendar has.
    """
    moves = F.when(F.col("kind") == "fetch", F.when(F.col("value") > 0, 0.95).otherwise(0.1)).otherwise(F.col("value"))
    day = F.to_date(F.timestamp_micros("at"))
    once = observations.dropDuplicates(["key", "kind", "id"]).select("key", "kind", "at", "id", moves.cast("double").alias("value"), day.alias("day"))
    dealt = scans.pieces(once, ["key", "kind"], ["at", "id"])
    of_piece = dealt.groupBy("key", "kind", "day", "piece").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "select", F.struct("at", "id", "value")))), lambda e: e["value"]).alias("values"))
    earlier = Window.partitionBy("key", "kind").orderBy("day", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = of_piece.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    still = scans.line(F.lit(1.0), F.lit(0.0))
    steps = F.transform("values", lambda v, i: F.when(v.isNull(), still).when(F.col("kind") == "search", search_step(v, F.col("before") + i + 1)).otherwise(halving_step(v)))
    folded = placed.select("key", "kind", "day", "piece", F.aggregate(steps, still, scans.line_then).alias("map"))
    maps = scans.composed(folded, ["key", "kind", "day"], scans.line_then)
    counts = of_piece.groupBy("key", "kind", "day").agg(F.sum("n").alias("n"))
    whole = F.coalesce("key", F.lit("\x00"))
    both = maps.withColumn("key", whole).join(counts.withColumn("key", whole), ["key", "kind", "day"])
    days = both.groupBy("key", "kind").agg(F.array_sort(F.collect_list(F.struct("day", "n", "map"))).alias("days"))
    seen = F.struct(F.lit(0.5).alias("s"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<day:date,s:double,n:bigint>>").alias("out"))

    def ran(acc, d):
        s, n = scans.line_at(d["map"], acc["s"]), acc["n"] + d["n"]
        return F.struct(s.alias("s"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(d["day"].alias("day"), s.alias("s"), n.alias("n")))).alias("out"))

    stood = days.select("key", "kind", F.explode(F.aggregate("days", seen, ran, lambda acc: acc["out"])).alias("d"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(f"d.{c}")))
    wide = stood.groupBy("key", F.col("d.day").alias("day")).agg(*(of(kind, c).alias(f"{name}_{told}") for kind, name in (("search", "search"), ("content", "content"), ("fetch", "availability"), ("select", "utility")) for c, told in (("s", "score"), ("n", "samples")) if (name, c) != ("utility", "s")))
    upto = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.5 if c.endswith("score") else 0))
    return wide.select(F.nullif("key", F.lit("\x00")).alias("key"), "day", *(kept(c).cast("double" if c.endswith("score") else "int").alias(c) for c in STANDING))


def standing_as_of(asked: DataFrame, observations: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """``asked`` with STANDING and last_seen: the reputation of its key before the day of its time.

    What is observed on a day counts from the next one on, so a result never sees its own outcome.
    Without an earlier observation scores are null, samples 0.
    """
    known = daily(observations).select(F.col("key").alias(key), (F.unix_micros(F.date_add("day", 1).cast("timestamp"))).alias(at), F.struct("day", *STANDING).alias("value"))
    found = scans.as_of(asked, known, "value", key, at, "__stood")
    of = lambda c: F.coalesce(F.col(f"__stood.value.{c}"), F.lit(0)) if c.endswith("samples") else F.col(f"__stood.value.{c}")
    return found.withColumns({c: of(c) for c in STANDING} | {"last_seen": F.col("__stood.value.day")}).drop("__stood")


def lookup(results: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """With rep_score, rep_samples, rep_factor, rep_badge and rep_scope by URL.

    A path's entry stands in for its host's once it has LEAST_SAMPLES of its own.  Without an
    entry the score is null and the factor 1.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_seen").cast("date")).cast("double")
    score = decayed(effective(F.col("search_score"), F.col("content_score"), F.col("content_samples")), age)
    ready = entries.select("key", score.alias("score"), (F.col("search_samples") + F.col("content_samples")).alias("samples"), "search_samples", "content_samples", "availability_score", "availability_samples", "utility_samples")
    e = F.struct(*(c for c in ready.columns if c != "key"))
    keyed = results.withColumn("keys", col(urls.rep_keys, "url"))
    host = ready.select(F.col("key").alias("host_key"), e.alias("host"))
    path = ready.select(F.col("key").alias("path_key"), e.alias("path"))
    both = keyed.withColumn("host_key", F.get("keys", 0)).withColumn("path_key", F.get("keys", 1)).join(host, "host_key", "left").join(path, "path_key", "left")
    own = (F.col("path.samples") >= LEAST_SAMPLES) | (F.col("path.availability_samples") >= LEAST_SAMPLES) | (F.col("path.utility_samples") >= LEAST_SAMPLES)
    use = F.coalesce(own, F.lit(False))
    both = both.withColumn("e", F.when(use, F.col("path")).otherwise(F.col("host"))).withColumn("rep_scope", F.when(use, F.col("path_key")).when(F.col("host").isNotNull(), F.col("host_key")))
    uses = F.when(use & (F.col("path.utility_samples") >= LEAST_SAMPLES), F.col("path.utility_samples")).otherwise(F.col("host.utility_samples"))
    all_ = clamp(factor(F.col("e.score"), F.coalesce(F.col("e.samples"), F.lit(0))) * availability_factor(F.col("e.availability_score"), F.col("e.availability_samples")) * utility_factor(uses), 0.35, 1.15)
    out = both.withColumns({"rep_score": F.col("e.score"), "rep_samples": F.col("e.samples"), "rep_search_samples": F.col("e.search_samples"), "rep_content_samples": F.col("e.content_samples"), "rep_factor": all_, "rep_badge": badge(F.col("e.score"), F.coalesce(F.col("e.samples"), F.lit(0)))})
    return out.drop("e", "host", "path", "host_key", "path_key", "keys")


def applied(results: DataFrame) -> DataFrame:
    """quality times rep_factor, within 0.05 and 1.15."""
    return results.withColumn("quality", clamp(F.col("quality") * F.col("rep_factor"), 0.05, 1.15))


def feature_weights(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, token, x) of ``t:`` and ``u:`` tokens; each kind sums to 1 within a row."""
    each = rows.select(id_col, F.explode("tokens").alias("token")).where("token LIKE 't:%' OR token LIKE 'u:%'")
    return each.withColumn("x", 1.0 / F.count("*").over(Window.partitionBy(id_col, F.substring("token", 1, 2))))


def prior(rows: DataFrame, weights: DataFrame, effective_samples: float, id_col: str = "id") -> DataFrame:
    """(id, prior): the prediction of token weights, pulled to 0.5 while samples are few."""
    z = feature_weights(rows, id_col).join(weights, "token", "left").groupBy(id_col).agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("x")).alias("z"))
    trust = min(1.0, effective_samples / PRIOR_FULL)
    return z.select(id_col, clamp(0.5 + (1 / (1 + F.exp(-F.col("z"))) - 0.5) * (0.5 + 0.5 * trust), PRIOR_LOW, PRIOR_HIGH).alias("prior"))


def ftrl(events, half_life_days: float = 90.0, as_of_ms: int | None = None) -> dict[str, float]:
    """Weights after following events (at, id, label, confidence, tokens) in order.

    Confidence halves every ``half_life_days`` before ``as_of_ms``.  Order matters, so a model's
    ledger (2000 events by its own bound) is one sequence; ``fit_prior`` runs one per model.
    """
    z: dict[str, float] = {}
    n: dict[str, float] = {}
    w: dict[str, float] = {}
    for e in sorted(events, key=lambda e: (e["at"], e["id"])):
        kinds: dict[str, list[str]] = {}
        for t in e["tokens"]:
            if t[:2] in ("t:", "u:"):
                kinds.setdefault(t[:2], []).append(t)
        x = {t: 1 / len(ts) for ts in kinds.values() for t in ts}
        confidence = min(1.0, max(0.0, e["confidence"]))
        if as_of_ms is not None:
            confidence *= 0.5 ** (max(0, as_of_ms - e["at"]) / 86_400_000 / half_life_days)
        if not x or confidence <= 0:
            continue
        miss = e["label"] - 1 / (1 + math.exp(-sum(w.get(t, 0.0) * v for t, v in x.items())))
        for t, v in x.items():
            g = -max(-1.0, min(1.0, miss)) * v * confidence
            more = n.get(t, 0.0) + g * g
            z[t] = z.get(t, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(t, 0.0))) / RATE * w.get(t, 0.0)
            n[t] = more
            w[t] = 0.0 if abs(z[t]) <= L1 else -(z[t] - math.copysign(L1, z[t])) / ((BETA + math.sqrt(more)) / RATE + L2)
    return w


def fit_prior(events: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """(model, token, w) from (model, at, id, label, confidence, tokens), a sequence for each model."""
    import pandas as pd

    def run(pdf):
        w = ftrl(pdf.drop_duplicates("id").to_dict("records"), as_of_ms=as_of_ms)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]] * len(w), "token": list(w), "w": list(w.values())})

    return events.groupBy("model").applyInPandas(run, "model string, token string, w double")


def metrics(predictions: DataFrame) -> DataFrame:
    """Brier score, mean absolute error, neutral Brier score (of 0.5 for all), low recall and good false positives at 0.4 or less, by fold."""
    p, y = F.col("pred"), F.col("label")
    rate = lambda of, when: F.avg(F.when(when, F.when(of, 1.0).otherwise(0.0)))
    return predictions.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg((0.5 - y) * (0.5 - y)).alias("neutral_brier"), F.avg(F.abs(p - y)).alias("mae"), rate(p <= 0.4, y <= 0.35).alias("low_recall"), rate(p <= 0.4, y >= 0.65).alias("good_fpr")
    )


def fold(domain: Column) -> Column:
    """One of five folds by the domain's hash."""
    return (F.conv(F.substring(F.sha2(domain, 256), 1, 2), 16, 10).cast("int") % 5).cast("bigint")


def ready(effective_samples: Column, positive: Column, negative: Column) -> Column:
    """Whether the cross-site prior has seen enough of either kind to speak."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return (n(effective_samples) >= READY_SAMPLES) & (n(positive) >= READY_CLASS) & (n(negative) >= READY_CLASS)


def blended(looked: DataFrame) -> DataFrame:
    """``lookup``'s rows with a ``prior`` (null: none): score, factor and badge with the prior blended in.

    Own evidence is trusted as it grows, and the prior fades; without evidence it stands alone.
    """
    samples, content = F.coalesce("rep_samples", F.lit(0)), F.coalesce("rep_content_samples", F.lit(0))
    by_search = clamp((F.coalesce("rep_search_samples", F.lit(0)) - 1) / float(LEAST_SAMPLES - 1), 0.0, 1.0)
    by_content = F.when(content > 0, clamp(0.6 + (content - 1) * 0.2, 0.0, 1.0)).otherwise(0.0)
    raw = F.when(samples > 0, F.col("rep_score")).otherwise(0.5)
    weight = F.when(F.col("prior").isNull(), 0.0).when(samples == 0, 1.0).otherwise(clamp(0.6 * (1 - samples / 10.0) - content * 0.2, 0.0, 0.6))
    own = F.when(F.col("prior").isNull(), raw).otherwise(0.5 + (raw - 0.5) * F.greatest(by_search, by_content))
    out = looked.withColumn("prior_weight", weight).withColumn("blend", own * (1 - weight) + F.coalesce("prior", F.lit(0.0)) * weight)
    counted = F.when(F.col("prior").isNotNull(), F.greatest(samples, F.lit(LEAST_SAMPLES))).otherwise(samples)
    told = lambda kind: F.concat(F.lit(f"[{kind}:"), F.format_string("%.2f", "blend"), F.lit("]"))
    mark = F.when((samples == 0) & F.col("prior").isNotNull(), told("meta")).when(F.col("prior_weight") > 0, told("blend")).otherwise(badge(F.col("blend"), counted))
    return out.withColumn("rep_factor", factor(F.col("blend"), counted)).withColumn("rep_badge", mark).withColumn("rep_score", F.col("blend")).drop("blend")


def discounted(observations: DataFrame) -> DataFrame:
    """Search observations (key, id, at, contribution, low) with value: less where a key was mostly low before.

    An observation after five or more others of its key, over 0.6 of them low, counts 0.6.
    """
    before = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    n, low = F.count("*").over(before), F.coalesce(F.sum(F.col("low").cast("int")).over(before), F.lit(0))
    return observations.withColumn("value", F.when((n >= 5) & (low / F.greatest(n, F.lit(1)) > 0.6), F.col("contribution") * 0.6).otherwise(F.col("contribution")))


def overview(entries: DataFrame, most: int = 8) -> DataFrame:
    """(side, place, key, score): the lowest and the highest ``most`` keys by score, ties by key."""
    low = entries.orderBy("score", "key").limit(most).withColumn("side", F.lit("lowest")).withColumn("by", F.col("score"))
    high = entries.orderBy(F.desc("score"), "key").limit(most).withColumn("side", F.lit("highest")).withColumn("by", -F.col("score"))
    both = low.unionByName(high)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("by", "key"))).select("side", "place", "key", "score")


def top_weights(weights: DataFrame, most: int = 10) -> DataFrame:
    """(token, w): the weights of largest size, ties by token."""
    return weights.orderBy(F.desc(F.abs("w")), "token").limit(most)


def migrated(ledger: DataFrame, version: int = 4) -> DataFrame:
    """Rows of a ledger (version, key, search_score, search_samples, fetch_samples) that still hold.

    The version before keeps keys without fetches, whose content and availability start anew; older
    ones go.
    """
    fresh = {"content_score": 0.5, "availability_score": 0.5}
    old = ledger.where(F.col("version") == version - 1).where(F.coalesce("fetch_samples", F.lit(0)) == 0)
    now = ledger.where(F.col("version") == version)
    for name, value in fresh.items():
        old = old.withColumn(name, F.lit(value))
        now = now if name in now.columns else now.withColumn(name, F.lit(value))
    return now.unionByName(old.withColumn("version", F.lit(version).cast(dict(ledger.dtypes)["version"])))
