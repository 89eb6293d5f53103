"""Sequential ids and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.joins import Target, lookup_join
from larkspur.session import written


def sequential_ids(df: DataFrame, order: list[str | Column], start: int = 0, id: str = "id") -> DataFrame:
    """df with ids from start on without gaps, in the order of the columns given.

    Rows are range-sorted; each range is numbered by itself and moved by the counts of those before, so no task sees all.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ids")
    counts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.join(F.broadcast(before), "_part").select((place - 1 + F.col("_before") + start).cast("long").alias(id), *df.columns)


def dictionary(df: DataFrame, column: str, old: DataFrame | None = None) -> DataFrame:
    """(id, value) of the distinct values, ids from 0 in their order; with an old dictionary, new values go on after it."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    if old is None:
        return sequential_ids(values, ["value"])
    size = old.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    return old.select("id", "value").unionByName(sequential_ids(values.join(old.select("value"), "value", "left_anti"), ["value"], size))


def dictionary_sizes(dictionaries: dict[str, DataFrame]) -> DataFrame:
    """(column, size)."""
    out = None
    for name, d in dictionaries.items():
        one = d.agg(F.count(F.lit(1)).alias("size")).select(F.lit(name).alias("column"), "size")
        out = one if out is None else out.unionByName(one)
    return out


def encode(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """Each column's values replaced by their ids; rows with a value that is in no dictionary go."""
    for c, d in dictionaries.items():
        df = lookup_join(df.withColumn(c, F.col(c).cast("string")), [c], [Target(d, ["value"], ["id"], "sub", [c])])
    return df


def decode(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The reverse of encode."""
    for c, d in dictionaries.items():
        df = lookup_join(df, [c], [Target(d, ["id"], ["value"], "sub", [c])])
    return df
