"""Importance resampling towards a target corpus, by an exact integer-score histogram.

Texts are hashed n-gram features.  Counts of each bucket over all source and all target texts give
its gain, the thousandfold log ratio of the two smoothed shares; a text's weight is the floored mean
gain of its features, looked up in one array.  Weighted sampling without replacement draws the
highest of weight plus Gumbel noise, which comes from the id alone.  Scores are integers, so a
histogram of them holds every rank: suffix sums give the number of rows above each score, and the
score at which the draw ends.  Rows below it are never sorted; those above are numbered within
their score only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .words import LOWER, UPPER

#: What parts words, after A-Z have become lower case: ASCII that is neither a digit nor a letter.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST_WORDS, SHARE = 10_000, 2024, 20, 10


def words(text: Column) -> Column:
    """Words of a text, A-Z as a-z; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTING), "")


def features(of: str, most: int = 1, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to ``most`` consecutive words of an array column, repeats included."""
    runs = [f"transform({of}, w -> CAST(crc32(CAST(w AS BINARY)) % {buckets} AS INT))"]
    for n in range(2, most + 1):
        runs.append(f"CASE WHEN size({of}) < {n} THEN array() ELSE transform(sequence(1, size({of}) - {n - 1}), i -> CAST(crc32(CAST(array_join(slice({of}, i, {n}), ' ') AS BINARY)) % {buckets} AS INT)) END")
    return F.expr(f"concat({', '.join(runs)})")


def counts(rows: DataFrame, of: str = "features") -> dict[int, int]:
    """Features in each bucket, counted map-side first; a number for each bucket reaches the driver."""
    each = rows.select(F.explode(of).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r.bucket: r.n for r in each.collect()}


def gains(source: dict[int, int], target: dict[int, int], spark, buckets: int = BUCKETS) -> list[int]:
    """Thousandfold log ratio of each bucket's smoothed target and source shares, floored.

    Worked out by the same functions and in the same order as SQL would, in doubles.
    """
    total, wanted = float(sum(source.values())), float(sum(target.values()))
    rows = [(b, float(source.get(b, 0)), float(target.get(b, 0))) for b in range(buckets)]
    ratio = (F.col("t") + 1) * (F.lit(total) + buckets) / ((F.col("s") + 1) * (F.lit(wanted) + buckets))
    found = spark.createDataFrame(rows, "b int, s double, t double").select("b", F.floor(1000 * F.ln(ratio)).alias("gain"))
    return [r.gain for r in sorted(found.collect())]


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel noise of an id, floored: a function of seed and id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", target_text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_features, weight, score) of every row of ``docs``.

    A text without words (null and empty ones too) has no features and weight 0.  Rows that repeat
    an id share its noise; a null id's is that of an empty one.  Without any target text all
    buckets' targets are 0.  Texts are parsed once: buckets are staged, at about a quarter of the
    texts' size.
    """
    spark = docs.sparkSession
    parsed = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select("id", F.size("w").cast("bigint").alias("n_words"), features("w", most, buckets).alias("features"))
    source = shared.stage(parsed, "importance-features")
    wanted = target.select(words(F.col(target_text_col)).alias("w")).select(features("w", most, buckets).alias("features"))
    gain = gains(counts(source), counts(wanted), spark, buckets)
    # one foldable text instead of ``buckets`` literals; folded to an array once
    array = f"CAST(split('{','.join(map(str, gain))}', ',') AS ARRAY<BIGINT>)"
    n = F.size("features").cast("bigint")
    total = F.expr(f"aggregate(features, 0L, (t, b) -> t + {array}[b])")
    # ``div`` and ``%`` go towards zero; the floor of a negative mean is one less where a rest is left
    mean = F.expr("CASE WHEN n = 0 THEN 0L WHEN total % n < 0 THEN total div n - 1 ELSE total div n END")
    out = source.withColumns({"n": n, "total": total}).withColumn("weight", mean)
    return out.select(F.col("id").alias(id_col), "n_words", F.col("n").alias("n_features"), "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def drawn(scores: DataFrame, eligible: Column, share: int = SHARE, id_col: str = "doc_id") -> DataFrame:
    """``scores`` with rank: 1, 2, ... of the drawn rows by (score downwards, id), else null.

    Of N eligible rows the first floor(share * N / 100) are drawn; ties of score and id in any
    order.  The histogram holds a row for each integer score: scores are thousandfold logarithms,
    so these are some ten thousand whatever the table's size.  Noise by id spreads even equal texts
    over thousands of scores, of which none holds more than 0.04 % of the rows.
    """
    spark = scores.sparkSession
    marked = scores.withColumn(shared.unused(scores, "eligible"), F.coalesce(eligible, F.lit(False)))
    flag = marked.columns[-1]
    histogram = sorted(((r["score"], r["n"]) for r in marked.where(flag).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    want = share * sum(n for _, n in histogram) // 100
    above, offsets = 0, []
    for score, n in histogram:
        if above >= want:
            break
        offsets.append((score, above))
        above += n
    kind = dict(scores.dtypes)["score"]
    if not offsets:
        return marked.drop(flag).withColumn("rank", F.lit(None).cast("bigint"))
    cutoff = offsets[-1][0]
    survives = F.col(flag) & (F.col("score") >= cutoff)
    before = spark.createDataFrame(offsets, f"score {kind}, above bigint")
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    high = marked.where(survives).join(F.broadcast(before), "score").withColumn("rank", F.col("above") + nth)
    high = high.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    low = marked.where(~survives).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [*scores.columns, "rank"]
    return high.select(columns).unionByName(low.select(columns))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """(``id_col``, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Rows of fewer than ``least_words`` words are scored but not drawn.  Other columns of ``docs``
    aren't passed on; an empty table gives no rows.
    """
    rows = shared.stage(scored(docs, target, text_col=text_col, id_col=id_col, **how), "importance-scores")
    return drawn(rows, F.col("n_words") >= least_words, share, id_col)


def _crc32_sql(of: str) -> str:
    """CRC-32 of a text's bytes in DuckDB, by the table in column ``crc``."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({of}) + 1), lambda i: CAST('0x' || substr(hex(encode({of})), 2 * i - 1, 2) AS BIGINT))), "
        "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    )


#: The same rows; each distinct word's CRC-32 is worked out from the polynomial.
RESAMPLE_SQL = f"""
WITH steps AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS crc FROM (SELECT unnest(range(0, 256)) AS k)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PARTING}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PARTING}'), lambda w: w <> '')) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(w) AS word FROM d),
hashed AS (SELECT word, {_crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM b), steps),
s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM each)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM b)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM each JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
