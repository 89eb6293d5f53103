"""Lookup targets written as text: path:source columns:key columns:value columns:kind, several joined by two colons."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.joins import Target
from larkspur.sources.delimited import comma_fields, index_list

_target = re.compile(r"(.+?):([^:/]*):([^:/]*):([^:/]*):(inner|outer|filter|sub)(?:::|$)")


def read_places(spark: SparkSession, path: str, width: int) -> DataFrame:
    """c0, c1, ... of delimited lines; columns that a line lacks are empty text."""
    parts = spark.read.text(path).select(comma_fields(F.col("value")).alias("p"))
    return parts.select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)])


def targets(spark: SparkSession, text: str) -> list[Target]:
    """The targets of a lookup_join whose source has columns c0, c1, ...; values are named v<target>_<column>."""
    out = []
    for n, m in enumerate(_target.finditer(text)):
        path, source, key, value, kind = m.groups()
        replaces, keys, values = (index_list(x) for x in (source, key, value))
        table = read_places(spark, path, max([0, *keys, *values]) + 1)
        out.append(Target(table, [f"c{i}" for i in keys], [f"c{i}" for i in values], kind, [f"c{i}" for i in replaces], [f"v{n}_{i}" for i in values]))
    return out
