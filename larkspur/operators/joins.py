"""Lookup joins, which never multiply rows, and equi-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import broadcast_if_small


@dataclass
class Target:
    """A side of a lookup join. kind: inner, outer, filter or sub; replaces: for sub, the source columns that values replace."""

    table: DataFrame
    key: list[str]
    values: list[str] = field(default_factory=list)
    kind: str = "inner"
    replaces: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def one_per_key(table: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The least values of each key: which of several rows a lookup takes does not depend on their order."""
    return table.groupBy(*key).agg(F.min(F.struct(*values)).alias("_v")) if values else table.select(*key).distinct()


def lookup_join(source: DataFrame, key: list[str], targets: list[Target], default: object = "null", small: bool = False) -> DataFrame:
    """Each target in turn: inner drops rows without a match and appends values; outer appends the default instead; filter
    drops rows with a match; sub replaces columns and drops rows without a match.

    small: targets are broadcast as far as their size is checked to be small. Otherwise Spark chooses.
    """
    out = source
    for n, t in enumerate(targets):
        keyed = [f"_k{n}_{i}" for i in range(len(t.key))]
        side = one_per_key(t.table, t.key, [] if t.kind == "filter" else t.values)
        side = side.select(*[F.col(k).alias(a) for k, a in zip(t.key, keyed)], *([] if t.kind == "filter" else [F.col("_v").alias(f"_v{n}")]))
        side = broadcast_if_small(side) if small else side
        match = [F.col(f"_s.{k}") == F.col(a) for k, a in zip(key, keyed)]
        left = out.alias("_s")
        if t.kind == "filter":
            out = left.join(side, match, "left_anti")
            continue
        joined = left.join(side, match, "left" if t.kind == "outer" else "inner").drop(*keyed)
        if t.kind == "sub":
            put = {c: F.col(f"_v{n}.{v}") for c, v in zip(t.replaces, t.values)}
            out = joined.select(*[put.get(c, F.col(c)).alias(c) for c in out.columns])
        elif t.kind in ("inner", "outer"):
            names = t.names or t.values
            value = [F.col(f"_v{n}.{v}") for v in t.values]
            if t.kind == "outer":
                value = [F.when(F.col(f"_v{n}").isNull(), F.lit(default)).otherwise(v) for v in value]
            out = joined.select(*out.columns, *[v.alias(a) for v, a in zip(value, names)])
        else:
            raise ValueError(f"no such kind of target: {t.kind}")
    return out


def equi_join(left: DataFrame, right: DataFrame, on: list[str], values: list[str], right_values: list[str], how: str = "inner", default: object = "0") -> DataFrame:
    """Key, left values and right values of all matching pairs; how: inner, left (missing values get the default) or minus."""
    a = left.select(*on, *values)
    if how == "minus":
        return a.join(right.select(*on), on, "left_anti")
    b = right.select(*on, *right_values, F.lit(True).alias("_there"))
    out = a.join(b, on, how)
    if how == "left":
        out = out.select(*on, *values, *[F.when(F.col("_there"), F.col(c)).otherwise(F.lit(default).cast(right.schema[c].dataType)).alias(c) for c in right_values])
    return out.drop("_there")


def cogroup(vectors: DataFrame, prefs: DataFrame, key: str, vector: str, item: str, value: str) -> DataFrame:
    """Each key of vectors with its vector and its preferences as two arrays, by item; empty where it has none.

    A key must have one vector: the result has a row for each, and one_vector tells where that is broken.
    """
    own = prefs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(item, value))).alias("_p"))
    once = vectors.groupBy(key).agg(F.first(vector).alias(vector), (F.count(F.lit(1)) == 1).alias("one_vector"))
    empty = F.coalesce(F.col("_p"), F.array().cast(own.schema["_p"].dataType))
    return once.join(own, key, "left").select(key, vector, "one_vector", F.transform(empty, lambda x: x[item]).alias("items"), F.transform(empty, lambda x: x[value]).alias("values"))
