"""Vector functions over arrays of doubles, and score formulas (expression builders)."""

from __future__ import annotations

from .dialect import Dialect


def dot(d: Dialect, a: str, b: str) -> str:
    """Dot product; null where lengths differ."""
    if d.spark:
        return f"CASE WHEN size({a}) = size({b}) THEN aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (t, x) -> t + x) END"
    return f"CASE WHEN len({a}) = len({b}) THEN coalesce(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]), 0) END"


def norm(d: Dialect, a: str) -> str:
    return f"sqrt({dot(d, a, a)})"


def cosine(d: Dialect, a: str, b: str) -> str:
    """Cosine; null where lengths differ or a vector is zero."""
    return f"CASE WHEN {norm(d, a)} * {norm(d, b)} > 0 THEN {dot(d, a, b)} / ({norm(d, a)} * {norm(d, b)}) END"


def unit(d: Dialect, a: str) -> str:
    """The vector at length 1; a zero vector as it is."""
    return d.let(norm(d, a), "n", d.each(a, "x", "CASE WHEN n > 0 THEN CAST(x AS DOUBLE) / n ELSE CAST(x AS DOUBLE) END"))


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def clamp(x: str, low: str, high: str) -> str:
    return f"least({high}, greatest({low}, {x}))"


def jaccard(d: Dialect, a: str, b: str) -> str:
    """Of two arrays without repeats; 0 if either is empty."""
    both = d.size(f"{'array' if d.spark else 'list'}_intersect({a}, {b})")
    return f"CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN {d.num(0.0)} ELSE {both} / CAST({d.size(a)} + {d.size(b)} - {both} AS DOUBLE) END"
