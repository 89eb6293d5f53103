"""Delimited text: lines without a header, columns by place, rows of any width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def comma_fields(line: Column) -> Column:
    """Parts between commas; empty parts at the end go."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


def pref_fields(line: Column) -> Column:
    """Parts between tabs or commas."""
    return F.split(line, "[\t,]")


def read_lines(spark: SparkSession, *paths: str, tag: str | None = None) -> DataFrame:
    """value; tag: a column with the number of the path a line comes from."""
    out = None
    for i, p in enumerate(paths):
        one = spark.read.text(p)
        one = one.withColumn(tag, F.lit(i)) if tag else one
        out = one if out is None else out.unionByName(one)
    return out


def read_columns(spark: SparkSession, path: str, schema: dict[str, str], prefs: bool = False) -> DataFrame:
    """Lines as typed columns; rows in which a column is missing or doesn't cast are skipped."""
    parts = (pref_fields if prefs else comma_fields)(F.col("value"))
    df = spark.read.text(path).select(parts.alias("p"))
    df = df.select(*[F.get("p", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(schema.items())])
    return df.dropna(subset=list(schema))


def index_list(text: str) -> list[int]:
    """The whole numbers of a comma-separated list, in order; other parts are skipped."""
    return [int(x) for x in (y.strip() for y in text.split(",")) if x.isascii() and x.isdigit()]


def encode_fields(fields: Column, columns: list[int]) -> Column:
    """The fields at some places joined by commas; places out of range are left out."""
    return F.array_join(F.filter(F.array(*[F.get(fields, F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ",")


def fetch_fields(fields: Column, columns: list[int]) -> Column:
    """The same, with empty text for places out of range."""
    return F.array_join(F.array(*[F.coalesce(F.get(fields, F.lit(c)), F.lit("")) for c in columns]), ",")


def side_table(spark: SparkSession, path: str, key: list[int], value: list[int], prefs: bool = False) -> DataFrame:
    """(key, value) of a lookup file, one row per key: of several the last one, by file and place in it."""
    parts = (pref_fields if prefs else comma_fields)(F.col("value"))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = spark.read.text(path).select(parts.alias("p"), place.alias("at")).select(fetch_fields(F.col("p"), key).alias("key"), fetch_fields(F.col("p"), value).alias("value"), "at")
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def as_lines(df: DataFrame) -> DataFrame:
    """value: a row's columns joined by commas, null as nothing."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
