"""Merging result lists of several sources: ranks, URL dedup, counts, targets and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, urls

PAGE_LIMIT = 10


def ranked(lists: DataFrame) -> DataFrame:
    """With source_rank and source_count inside each source's list, before any dedup."""
    own = Window.partitionBy("query_id", "src")
    return lists.withColumn("source_rank", F.row_number().over(own.orderBy("pos"))).withColumn("source_count", F.count("*").over(own))


def merged(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each URL key and query: the first by source order and position; with ``idx``.

    Same title at another URL is another result.
    """
    keyed = ranked(lists).withColumn("url_key", col(urls.dedup_key, "url"))
    first = Window.partitionBy("query_id", "url_key").orderBy("src_order", "pos")
    kept = keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    kept = kept.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy("src_order", "pos")) - 1)
    return kept.where(F.col("idx") < limit) if limit else kept


def counts(lists: DataFrame) -> DataFrame:
    """(query_id, src, fetched, kept)."""
    kept = merged(lists).groupBy("query_id", "src").agg(F.count("*").alias("kept"))
    return lists.groupBy("query_id", "src").agg(F.count("*").alias("fetched")).join(kept, ["query_id", "src"], "left").select("query_id", "src", "fetched", F.coalesce("kept", F.lit(0)).alias("kept"))


def note(counts_: DataFrame) -> DataFrame:
    """(query_id, note): kept and fetched of each source, in order of its name."""
    each = F.concat("src", F.lit("×"), "kept", F.lit("("), "fetched", F.lit(")"))
    return counts_.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(each)), " + ").alias("note"))


def targets(engines: DataFrame, limit: int) -> DataFrame:
    """(engine, target): how many rows to ask of each source for ``limit`` in all."""
    share = F.ceil(F.lit(limit) / F.count("*").over(Window.partitionBy()))
    return engines.select("engine", F.least(F.coalesce("page_limit", F.lit(PAGE_LIMIT)), F.greatest(share, F.least(F.lit(PAGE_LIMIT), F.lit(limit)))).cast("bigint").alias("target"))


def language_gate(queries: DataFrame, engines: DataFrame) -> DataFrame:
    """(query_id, engine) pairs that may run: the first engine always, others by language."""
    cjk = F.expr("regexp_like(query, r'[\\x{4e00}-\\x{9fff}]')")
    allowed = (F.col("ord") == 0) | (cjk & ~F.col("en_only")) | (~cjk & ~F.col("zh_only"))
    return queries.select("query_id", cjk.alias("cjk"), "query").join(F.broadcast(engines)).where(allowed).select("query_id", "engine")


def fallback_union(responses: DataFrame) -> DataFrame:
    """(query_id, engine) whose rows count.

    ``responses`` (query_id, engine, cjk, zh_only, ok, n): engines that answered; where none of
    the others did and the query isn't CJK, zh_only engines with rows.
    """
    regular = ~F.col("zh_only") | F.col("cjk")
    any_ok = F.max((regular & F.col("ok")).cast("int")).over(Window.partitionBy("query_id"))
    chosen = (regular & F.col("ok")) | ((any_ok == 0) & ~regular & F.col("ok") & (F.col("n") > 0))
    return responses.withColumn("chosen", chosen).where("chosen").select("query_id", "engine")


def fallback_chain(responses: DataFrame) -> DataFrame:
    """(query_id, engine): the first in order that isn't blocked, polluted or empty."""
    good = responses.where("NOT blocked AND NOT polluted AND n > 0")
    return good.groupBy("query_id").agg(F.min_by("engine", "ord").alias("engine"))


def language_pollution(results: DataFrame) -> DataFrame:
    """(query_id, polluted): half or more CJK titles for a query without CJK."""
    cjk = "regexp_like({}, r'[\\x{{4e00}}-\\x{{9fff}}]')"
    share = F.avg(F.expr(cjk.format("title")).cast("int"))
    return results.groupBy("query_id", "query").agg((share >= 0.5).alias("half")).select("query_id", (F.expr("NOT " + cjk.format("query")) & F.col("half")).alias("polluted"))


def resolved(results: DataFrame, redirects: DataFrame, *by: str) -> DataFrame:
    """``results`` with targets of known redirects (url, target) for their URLs; others keep theirs.

    Columns ``by`` that both have tell apart answers to one URL, such as those to several results.
    """
    known = redirects.where("coalesce(target, '') <> ''").groupBy("url", *by).agg(F.max("target").alias("target"))
    return results.join(known, ["url", *by], "left").withColumn("url", F.coalesce("target", "url")).drop("target")
