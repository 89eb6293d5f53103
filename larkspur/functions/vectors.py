"""Column expressions over dense arrays and over keys of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def tanimoto(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (dot(a, a) + dot(b, b) - dot(a, b))


#: Distances by name; more can be added.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "euclidean": euclidean,
    "squared_euclidean": squared_euclidean,
    "manhattan": manhattan,
    "tanimoto": tanimoto,
}


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two texts share from the start; null where either is."""
    most = F.least(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(most == 0, 0).otherwise(
        F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), most), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))) - 1, most)
    )


def prefix_ratio(a: Column, b: Column) -> Column:
    """Shared leading characters over the length of the first; 0 where it is empty."""
    return F.when(F.length(a) == 0, 0.0).otherwise(common_prefix(a, b) / F.length(a))
