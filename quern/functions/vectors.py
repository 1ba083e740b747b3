"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product, summed from the first component on."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    x = as_double(v)
    # the norm is bound once, or it would be summed anew for every component
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(x, lambda e: e / n)).otherwise(x)), 1)


def scaled(v: Column | str, by: Column) -> Column:
    return F.transform(as_double(v), lambda e: e * by)


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def fitted(v: Column | str, width: int) -> Column:
    """A longer vector cut to the index's width; a shorter one is null, and finds nothing."""
    x = as_double(v)
    return F.when(F.size(x) >= width, F.slice(x, 1, width))


def cells_for(n: int) -> tuple[int, int] | None:
    """(cells, cells probed) of an inverted index over n vectors; None where exhaustive search is used."""
    if n <= 10_000:
        return None
    cells = min(4096, max(50, n // 10))
    return cells, min(64, cells // 4)
