"""The contract queries ``opN_<name>`` over the driver tables, and SQL twins where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, hardneg, importance, lines, lm, quality, shared, simhash, suffix, tokenfiles, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; kept are texts that are good more likely than not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(5) == 0
    ratings = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.expr("quality * (2 - toxic)").alias("grade"))
    scored = quality.score(docs, quality.fit(docs, ratings))
    return scored.select("doc_id", held_out.alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_ge_1"), F.element_at("tails", -1).alias("p_ge_2"), "grade", (F.col("tails")[0] >= 0.5).alias("keep"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.vocabulary_file(spark)
    order = tokenfiles.write(table(spark, sf_dir, "documents"), f"{shared.shared_folder(spark)}/tokens", ranks, pattern)
    counted = tokenfiles.count(tokenfiles.sizes(spark, order))
    return order.join(counted.hint("merge"), ["file", "nth"]).select("doc_id", "n_tokens")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.vocabulary_file(spark)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs, _remainder(7) != 2)
    scored = lm.score(docs, model)
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes", "bits_per_byte")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("id") % 50 == 0)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), shared.shared_folder(spark))
    return warc.resolved(warc.captures(spark, archive)).drop("uri")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_token_counts, op4_bpe, op5_line_dedup, op6_suffix_dedup, op7_simhash, op8_ctw_scores, op9_toxicity, op10_decontaminate, op11_hard_negatives, op12_importance, op13_warc)}
ORACLE: dict[str, str] = {"op10_decontaminate": decontaminate.LEAKS_SQL, "op11_hard_negatives": hardneg.MINE_SQL, "op12_importance": importance.RESAMPLE_SQL, "op13_warc": warc.CAPTURES_SQL}
