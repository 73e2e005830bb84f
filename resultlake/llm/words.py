"""Word shingles by built-in functions only, for the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII letters fold to lower case; ASCII white space and punctuation part words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTING = "\t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FROM, TO = UPPER + PARTING, LOWER + " " * len(PARTING)


def words(text: Column) -> Column:
    """Folded words of a text (null: none)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), FROM, TO), " "), "")


def shingles(words: str, width: int = 5) -> Column:
    """Distinct 64-bit hashes of the ``width``-word shingles of an array column.

    Fewer words: the whole sequence; none: an empty array.
    """
    of = f"transform({words}, w -> xxhash64(w))"
    each = ", ".join(f"h[i + {k}]" for k in range(width))
    return F.expr(
        f"CASE WHEN size({words}) >= {width} THEN array_distinct(transform(array({of}), h -> transform(sequence(0, size(h) - {width}), i -> xxhash64({each})))[0]) "
        f"WHEN size({words}) > 0 THEN array(xxhash64({of})) ELSE array() END"
    )


def small(df: DataFrame, most: int, values: int = 0, array: str = "") -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most; else as it is, for a shuffle.

    With ``array``, a column of arrays, they may hold ``values`` values in all besides.
    """
    held = F.sum(F.size(array)) if array else F.lit(0)
    rows, size = df.limit(most + 1).agg(F.count("*"), held).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= values else df
