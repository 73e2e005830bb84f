"""Content evidence: structural rules, semantic contradiction, naive Bayes, and their chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.dialect import SPARK, WHITE, Dialect

PROMOTION = r"(?i)(立即(?:咨询|联系|购买|注册|下载|领取)|免费(?:咨询|试用|领取)|限时(?:优惠|折扣)|点击(?:咨询|购买|注册|下载)|添加(?:微信|客服)|扫码(?:咨询|购买)|优惠名额|咨询热线)"
#: What a promotion begins with.
PROMOTION_STARTS = "(?=[立免限点添扫优咨])"
#: reason: (label, confidence)
VERDICTS = {"repeated-body": (0.2, 0.8), "promotional-body": (0.15, 0.8), "title-body-mismatch": (0.25, 0.55), "substantive-aligned-body": (0.82, 0.65), "aligned-body": (0.72, 0.4), "uniform-sentence-length": (0.35, 0.4), "uniform-sentence-length+weak-negative": (0.35, 0.35)}
READY_SAMPLES, READY_CLASS, TOP_TOKENS, TOLD = 40, 10, 15, 0.65
#: Contents whose tokens one task holds, about.
DEALT = 10_000


def measures(d: Dialect, title: str, body: str, flat: str | None = None) -> dict[str, str]:
    """What the structural rules look at; ``flat``: the body with white space collapsed, if there is such a column."""
    if d.spark and flat:
        # no white space is left but single blanks, and no letter of the pattern has a case: the same counts by less work
        parts = d.split(flat, r"[。！？!?；;\n]+")
        lengths = d.each(d.keep(d.each(parts, "p", "trim(p)"), "p", "length(p) >= 8"), "p", "CAST(length(p) AS DOUBLE)")
        return {
            "n": f"CAST(length({flat}) AS BIGINT)",
            "promo": d.size(d.every(flat, PROMOTION_STARTS + PROMOTION.removeprefix("(?i)"))),
            "repeated": text.repetition(d, body),
            "coverage": text.title_coverage(d, title, flat),
            "lengths": lengths,
            "sentences": d.size("lengths"),
            "cv": text.cv(d, "lengths"),
        }
    flat = flat or text.trimmed(d, d.sub(body, f"{WHITE}+", " "))
    return {
        "n": f"CAST(length({flat}) AS BIGINT)",
        "promo": d.size(d.every(flat, PROMOTION)),
        "repeated": text.repetition(d, body),
        "coverage": text.title_coverage(d, title, flat),
        "sentences": text.sentence_count(d, flat),
        "cv": text.sentence_cv(d, flat),
    }


def reason(d: Dialect) -> str:
    """The first rule that holds, over the columns of ``measures``; null if none does."""
    x = d.num
    return f"""CASE WHEN n < 200 THEN NULL WHEN repeated >= {x(0.45)} THEN 'repeated-body'
      WHEN promo >= 3 AND (n < 1600 OR repeated >= {x(0.15)}) THEN 'promotional-body'
      WHEN coverage < {x(0.08)} AND n >= 700 THEN 'title-body-mismatch'
      WHEN n >= 1200 AND coalesce(coverage >= {x(0.25)}, true) AND repeated < {x(0.2)} AND promo <= 1 THEN 'substantive-aligned-body'
      WHEN n >= 600 AND coverage >= {x(0.35)} AND repeated < {x(0.15)} AND promo = 0 THEN 'aligned-body'
      WHEN n >= 600 AND sentences >= 10 AND cv < {x(0.1)} THEN 'uniform-sentence-length'
      WHEN n >= 600 AND sentences >= 10 AND cv < {x(0.25)} AND (promo >= 1 OR coalesce(coverage < {x(0.12)}, false)) THEN 'uniform-sentence-length+weak-negative' END"""


def verdict(d: Dialect, which: int) -> str:
    """Label (0) or confidence (1) of column ``reason``."""
    return "CASE reason " + " ".join(f"WHEN '{k}' THEN {d.num(v[which])}" for k, v in VERDICTS.items()) + " END"


def structural(contents: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """With reason, label and confidence of the structural rules, null where none holds."""
    flat = contents.withColumn("__flat", F.expr(text.trimmed(SPARK, SPARK.sub(body, f"{WHITE}+", " "))))
    told = measures(SPARK, title, body, "__flat")
    each = flat.withColumns({k: F.expr(told.pop(k)) for k in ("n", "promo", "repeated", "coverage", "lengths")})
    measured = each.withColumns({k: F.expr(e) for k, e in told.items()}).drop("__flat", "lengths")
    return measured.withColumn("reason", F.expr(reason(SPARK))).withColumn("label", F.expr(verdict(SPARK, 0))).withColumn("confidence", F.expr(verdict(SPARK, 1)))


def semantic(d: Dialect, title_vec: str, body_vec: str, length: str, threshold: float = 0.4) -> dict[str, str]:
    """Similarity, label and confidence where title and body contradict; null where they agree."""
    sim = vectors.cosine(d, title_vec, body_vec)
    told = f"({length} >= 300 AND {sim} < {d.num(threshold)})"
    confidence = vectors.clamp(f"{d.num(0.35)} + ({d.num(threshold)} - {sim}) * {d.num(1.2)}", d.num(0.3), d.num(0.6))
    return {"sim": f"round({sim}, 3)", "label": f"CASE WHEN {told} THEN {d.num(0.25)} END", "confidence": f"CASE WHEN {told} THEN {confidence} END"}


def bayes_fit(events: DataFrame) -> DataFrame:
    """(token, good, bad): confidence-weighted counts from (id, tokens, label, confidence).

    Labels below 0.4 are bad, above 0.6 good, others don't count; equal ids count once.
    """
    told = events.where("label < 0.4 OR label > 0.6").dropDuplicates(["id"])
    each = told.select("label", F.expr("least(1D, greatest(0D, confidence))").alias("w"), F.explode("tokens").alias("token"))
    return each.groupBy("token").agg(F.sum(F.when(F.col("label") > 0.6, F.col("w")).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("label") < 0.4, F.col("w")).otherwise(0.0)).alias("bad"))


def bayes_ready(events: DataFrame) -> DataFrame:
    """One row (samples, good, bad, ready): whether a model of these events may speak."""
    told = events.where("label < 0.4 OR label > 0.6").dropDuplicates(["id"])
    n = told.agg(F.count("*").alias("samples"), F.count_if(F.col("label") > 0.6).alias("good"), F.count_if(F.col("label") < 0.4).alias("bad"))
    return n.withColumn("ready", (F.col("samples") >= READY_SAMPLES) & (F.col("good") >= READY_CLASS) & (F.col("bad") >= READY_CLASS))


def bayes_gated(model: DataFrame, events: DataFrame) -> DataFrame:
    """``model`` as it is if its events are enough of either class, else without rows."""
    one = bayes_ready(events).where("ready").select(F.lit(1).alias("one"))
    return model.withColumn("one", F.lit(1)).join(F.broadcast(one), "one", "left_semi").drop("one")


def trainable(evidence: DataFrame) -> DataFrame:
    """Evidence that Bayes may learn from: none that it gave itself."""
    return evidence.where("source IS NOT NULL AND source <> 'bayes-v1'")


def bayes_predict(contents: DataFrame, model: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, prob, coverage) of contents (id, tokens) with four telling tokens or more.

    The TOP_TOKENS most telling ones count, ties in order of the token; products run as sums of
    logarithms.  Tokens are dealt to as many tasks as the contents need, so that what one sorts is bounded.
    """
    spark = contents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contents.count() // DEALT))
    p = (F.col("bad") + 1) / (F.col("good") + F.col("bad") + 2)
    telling = model.withColumn("p", p).withColumn("d", F.abs(F.col("p") - 0.5)).where("d > 0.05").select("token", "p", "d")
    each = contents.select(id_col, F.explode("tokens").alias("token")).repartition(parts, "token").join(telling, "token").repartition(parts, id_col)
    own = Window.partitionBy(id_col)
    top = each.withColumn("coverage", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc("d"), "token"))).where(f"coverage >= 4 AND nth <= {TOP_TOKENS}")
    sums = top.groupBy(id_col).agg(F.max("coverage").alias("coverage"), F.sum(F.log("p")).alias("yes"), F.sum(F.log(1 - F.col("p"))).alias("no"))
    return sums.select(id_col, (1 / (1 + F.exp(F.col("no") - F.col("yes")))).alias("prob"), "coverage")


def chain(contents: DataFrame) -> DataFrame:
    """One verdict a content: structural negative, semantic, structural positive, then Bayes.

    Columns: label/confidence (structural), sem_label/sem_confidence, prob; adds final_label,
    final_confidence and final_source.
    """
    by = F.when(F.col("label") < 0.5, "local-content-v1").when(F.col("sem_label").isNotNull(), "semantic-v1").when(F.col("label").isNotNull(), "local-content-v1").when(F.col("prob") >= TOLD, "bayes-v1")
    pick = lambda s, m, b: F.when(F.col("final_source") == "local-content-v1", s).when(F.col("final_source") == "semantic-v1", m).when(F.col("final_source") == "bayes-v1", b)
    out = contents.withColumn("final_source", by)
    return out.withColumn("final_label", pick(F.col("label"), F.col("sem_label"), F.lit(0.35))).withColumn("final_confidence", pick(F.col("confidence"), F.col("sem_confidence"), F.least(F.lit(0.5), 0.3 + F.col("prob") - TOLD)))
