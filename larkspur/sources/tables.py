"""The Parquet tables of a folder, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ratings(spark: SparkSession, folder: str, before: str | None = None, since: str | None = None) -> DataFrame:
    """user, item, rating: the quantity of each part that a customer ordered, by order date if asked."""
    orders = table(spark, folder, "orders")
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("rating"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings as a matrix."""
    return ratings(spark, folder).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value"))
