"""The search plan: merge, filter, order, reputation, cluster, score, grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPARK
from ..operators import cluster, embed, filters, grade, merge, reputation
from ..staging import staged

#: Results of a query that count.
LIMIT = 99


def search(lists: DataFrame, as_of: str, since: str | None = None, limit: int = LIMIT, stop: list[str] | None = None, entries: DataFrame | None = None, mode: str = "balanced") -> DataFrame:
    """``found`` of the first ``limit`` merged results of ``lists`` (``sources.tables.result_lists``)."""
    return found(filters.annotate(merge.merged(lists, limit)), as_of, since, stop, entries, mode)


def found(annotated: DataFrame, as_of: str, since: str | None = None, stop: list[str] | None = None, entries: DataFrame | None = None, mode: str = "balanced") -> DataFrame:
    """(query_id, place, idx, src, title, url, flags, quality, rep_badge, duplicate_of, cluster_id, score, grade, tier).

    ``annotated``: merged results with flags and quality; ``entries``: what is known
    of sites (``reputation.learned``), if anything: it scales a result's quality.  Later results that
    reprint an earlier one are folded into it before clustering and share its cluster.  Everything is
    keyed by query_id, so one query or a corpus of them runs the same plan.  Rows, vectors, reprints
    and clusters have several readers and are written once each.
    """
    rows = filters.since(annotated, since, as_of) if since else annotated
    rows = filters.split(rows).where("part <> 'ad'")
    rows = reputation.applied(reputation.lookup(rows, entries, as_of)) if entries is not None else rows.withColumn("rep_badge", F.lit(""))
    whole = rows.withColumn("__text", F.expr(text.embedded_text(SPARK, "title", "`desc`"))).withColumn("__id", F.struct("query_id", "idx"))
    rows = staged(embed.covered(staged(whole, "search-rated"), "query", "__text"), "search-rows")
    vectors = embed.projected(rows, "__text", "__id").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).where("norm > 0")
    vectors = vectors.select("__id", F.transform("v", lambda x: x / F.col("norm")).alias("vec"))
    pointed = staged(rows.join(vectors, "__id").select("query_id", "idx", "title", "desc", "vec"), "search-vectors")
    folded = staged(cluster.reprints(pointed), "search-reprints")
    rows = rows.drop("__text", "__id")
    members = staged(cluster.by_phrase(rows.join(folded, ["query_id", "idx"], "left_anti"), stop=stop), "search-members")
    scores = staged(cluster.scored(members, rows, cluster.text_scores(members, rows)), "search-scores")
    placed = cluster.assigned(members, scores)
    graded = grade.graded(scores.select("query_id", "cluster_id", "score", "sem_score", "text_score"), mode)
    ordered = filters.recency(rows, as_of).join(folded, ["query_id", "idx"], "left").withColumn("__home", F.coalesce("duplicate_of", "idx"))
    out = ordered.join(placed.withColumnRenamed("idx", "__home"), ["query_id", "__home"], "left").join(graded.select("query_id", "cluster_id", "score", "grade", "tier"), ["query_id", "cluster_id"], "left")
    return out.select("query_id", "place", "idx", "src", "title", "url", F.array_join("flags", "|").alias("flags"), "quality", "rep_badge", "duplicate_of", "cluster_id", "score", "grade", "tier")


def candidates(results: DataFrame, limit: int) -> DataFrame:
    """Of each query the first 3 ``limit`` results, dated ones first, else in order."""
    order = Window.partitionBy("query_id").orderBy((F.coalesce("date", F.lit("")) == "").cast("int"), "idx")
    return results.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 3 * limit).drop("nth")


def timeline(results: DataFrame, extracts: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """(query_id, place, month, date, title, url, summary): results by day, undated ones last, with their pages' first paragraph.

    With ``limit`` only ``candidates`` count.

    ``extracts`` (url, markdown, published): stored page texts.
    """
    from ..functions import dates

    results = candidates(results, limit) if limit else results
    own = results.join(extracts, "url", "left")
    day = F.expr(f"coalesce(nullif(published, ''), nullif({dates.absolute_of(SPARK, 'date', as_of)}, ''), nullif({dates.url_date(SPARK, 'url')}, ''))")
    summary = F.expr(f"coalesce(nullif({text.first_paragraph(SPARK, 'markdown')}, ''), substr(`desc`, 1, 150))")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("date"), "idx"))
    dated = own.withColumn("date", day).withColumn("summary", summary).withColumn("place", place)
    return dated.select("query_id", "place", F.substring("date", 1, 7).alias("month"), "date", "title", "url", "summary")


def spans(timeline_: DataFrame) -> DataFrame:
    """(query_id, n, months, first, last) of timelines: dated results, months with any, first and last day."""
    dated = timeline_.where("date IS NOT NULL")
    return dated.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("month").alias("months"), F.min("date").alias("first"), F.max("date").alias("last"))
