"""Benchmark decontamination: size-partitioned MinHash containment search, natively.

Short test items are sought inside long documents, so signatures stand on the items' side: for
each of several seeded permutations the item's least five-word shingle.  Items are
partitioned by size: the smallest have all their shingles as signature (and need one hit), larger
ones need hits of several permutations, the more the larger, as chance hits grow with the item
(``CLASSES``).  A document that contains a share c of an item's shingles hits each permutation with
probability c whatever the document's length; at 0.8 too few hits have probability 2e-7 or less.
Candidates are verified by exact containment of distinct shingles.  Joins broadcast the items' side
only after counting it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import FROM, TO, shingles, small, words

CONTAINMENT = 0.8
#: Size classes of items: most shingles, permutations (0: all shingles are the signature), hits needed.
CLASSES = ((8, 0, 1), (32, 14, 3), (128, 16, 4), (512, 20, 6), (1 << 31, 24, 8))
#: Most rows of a side that is broadcast (signatures and keys are 24 bytes or less), and values in their arrays.
BROADCAST_ROWS, BROADCAST_VALUES = 1_000_000, 1_000_000


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))


def signatures(items: DataFrame) -> DataFrame:
    """(item, need, permutation, shingle) from (item, shingles)."""

    def by_class(k: int):
        value = F.lit(CLASSES[-1][k])
        for c in CLASSES[-2::-1]:
            value = F.when(F.size("shingles") <= c[0], F.lit(c[k])).otherwise(value)
        return value

    each = items.select("item", by_class(1).alias("permutations"), by_class(2).alias("need"), F.explode("shingles").alias("shingle"))
    whole = each.where("permutations = 0").select("item", "need", F.lit(0).alias("permutation"), "shingle")
    seeded = each.where("permutations > 0").select("item", "need", "shingle", F.explode(F.expr("sequence(1, permutations)")).alias("permutation"))
    least = seeded.groupBy("item", "need", "permutation").agg(F.min_by("shingle", F.xxhash64("permutation", "shingle")).alias("shingle"))
    return whole.unionByName(least)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """(key, ``id_col``, ``item_id_col``, n_shared, n_item, containment) of contaminated documents.

    ``key``: hash of id and text.  Words fold ASCII case and lose ASCII punctuation.  An item of
    fewer than five words matches a document of just these words; empty or null items match
    nothing, empty documents are clean, an empty table of either kind gives no rows.  Repeated rows
    give one; different texts under one item's id are items each.
    """
    named = items.select(F.col(item_id_col).alias("item_id"), F.xxhash64(F.col(item_id_col), F.col(item_text_col)).alias("item"), words(F.col(item_text_col)).alias("w"))
    known = named.select("item_id", "item", shingles("w").alias("shingles")).where(F.size("shingles") > 0).dropDuplicates(["item"])
    known = shared.stage(known, "items")
    marks = small(shared.stage(signatures(known), "signatures"), BROADCAST_ROWS)
    keyed = _keyed(docs, text_col, id_col)
    probes = keyed.select("key", words(F.col("text")).alias("w")).select("key", F.explode(shingles("w")).alias("shingle"))
    hits = probes.join(marks, "shingle").groupBy("key", "item").agg(F.count_distinct("permutation").alias("hits"), F.max("need").alias("need"))
    candidates = shared.stage(hits.where("hits >= need").select("key", "item"), "candidates")
    found = keyed.join(small(candidates.select("key").distinct(), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])
    found = found.select("key", "id", words(F.col("text")).alias("w")).select("key", "id", shingles("w").alias("of_doc"))
    pairs = found.join(candidates, "key").join(small(known, BROADCAST_ROWS, BROADCAST_VALUES, "shingles"), "item")
    shared_n = F.size(F.array_intersect("shingles", "of_doc"))
    checked = pairs.select("key", F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), shared_n.cast("bigint").alias("n_shared"), F.size("shingles").cast("bigint").alias("n_item"))
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold).distinct()


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item; columns, nulls and repeats as they were."""
    bad = shared.stage(leaks(docs, items, text_col=text_col, id_col=id_col, **how).select("key").distinct(), "leaks")
    key = shared.unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(small(bad.withColumnRenamed("key", key), BROADCAST_ROWS), key, "left_anti").drop(key)


def _sql_shingles(table: str, id_col: str) -> str:
    fold = "translate(coalesce(text, ''), {}, {})".format(*("'" + s.replace("'", "''") + "'" for s in (FROM, TO)))
    return (
        f"SELECT DISTINCT {id_col}, text, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] "
        f"WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {id_col}, text, [x for x in string_split({fold}, ' ') if x <> ''] AS w FROM {table})"
    )


#: The same rows by exact containment of all pairs that share a shingle.
LEAKS_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}), b AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, text, count(*) AS n_item FROM b GROUP BY item_id, text),
p AS (SELECT doc_id, d.text AS doc, item_id, b.text, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, d.text, item_id, b.text)
SELECT DISTINCT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n USING (item_id, text) WHERE n_shared / n_item >= 0.8
"""
