"""A corpus pipeline of five stages over ``documents``; part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``.  All but the last return the columns of ``documents``; other
columns of ``docs`` aren't passed on.  An empty table stays one through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultlake.llm import bpe, decontaminate, lines, shared, simhash, toxicity
from resultlake.session import reachable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose most toxic window is toxic more likely than not go.

    Null and empty texts get the base rate and stay; repeated rows are judged each.
    """
    reachable(spark)
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where("toxicity < 0.5").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines one stays; documents stay, with the lines that are left.

    Of ties the first by id, hash and place stays.  A null text stays null, one all of whose lines
    go becomes empty; rows that repeat id and text keep the same lines.
    """
    reachable(spark)
    kept = lines.dedup(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id stays.

    Similar: 64-bit fingerprints of three-word shingles that differ in two bits or fewer.  Null ids
    come last, rows that repeat id and text give one; texts without words are one component.
    """
    reachable(spark)
    return simhash.distinct(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go.

    Null and empty texts hold none and stay, as do repeated rows of clean texts.
    """
    reachable(spark)
    return decontaminate.clean(docs.select(COLUMNS), _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests: one row for each row, null texts as empty ones."""
    reachable(spark)
    return bpe.digests(bpe.encode(docs, *bpe.vocabulary_file(spark)))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-duplicates", dedup_near), ("decontamination", decontaminated), ("bpe", encoded)]

#: SQL can express neither the trained network nor fuzzy hashing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
