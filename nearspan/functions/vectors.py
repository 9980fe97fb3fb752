"""Column builders for number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance over the shorter of the two lengths."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
