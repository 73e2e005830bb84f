"""Stored pages and states in folders by key: what a filter names is all that is listed and read.

``folder/engine=<engine>/day=<day>/...`` holds pages of one engine's day.  Engine and day are
partition columns, so Spark's planner turns predicates on them into the list of folders to read, on
any store that Spark reads; a source's time window (``between``) is such a predicate.  Folders are
replaced one by one: an attempt that fails leaves what was there, one that is repeated leaves what
it wrote once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "page_id bigint, url string, html string, engine string, day date"
MODE = "spark.sql.sources.partitionOverwriteMode"


def replace(rows: DataFrame, folder: str, *by: str) -> None:
    """Writes ``rows`` below ``folder``, a folder for each value of ``by``; other values' folders stay.

    Values that ``rows`` has none of keep what they had.  Null values are a folder of their own.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def append_once(rows: DataFrame, folder: str, batch: str) -> None:
    """Adds ``rows`` as batch ``batch``; the same batch again replaces it, so a replay doesn't double."""
    replace(rows.withColumn("batch", F.lit(batch)), folder, "batch")


def pages(spark: SparkSession, folder: str, engines: Iterable[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Pages (KEPT) of the named engines and of days from ``since`` to ``until``, all if None.

    The schema is given, not inferred, so planning opens no file; no engines give no rows.
    """
    rows = spark.read.schema(KEPT).parquet(folder)
    if engines is not None:
        rows = rows.where(F.col("engine").isin(*engines))
    return between(rows, since, until)


def between(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Rows whose ``day`` lies within both ends; rows without a day only where no end is named."""
    for end, keeps in ((since, lambda day, to: day >= to), (until, lambda day, to: day <= to)):
        rows = rows if end is None else rows.where(keeps(F.col("day"), F.lit(end).cast("date")))
    return rows
