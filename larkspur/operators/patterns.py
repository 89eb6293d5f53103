"""Frequent patterns: the best of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what parts the items of a line.
SPLITTER = r"[ ,\t]*[,|\t][ ,\t]*"


def transactions(lines: DataFrame, column: str = "value", splitter: str = SPLITTER) -> DataFrame:
    """items: the distinct items of each line."""
    return lines.select(F.array_distinct(F.filter(F.split(column, splitter), lambda x: x != "")).alias("items"))


def frequent_items(baskets: DataFrame, min_support: int = 3) -> DataFrame:
    """(item, n) of the items in at least min_support baskets, the most frequent first, then by name."""
    return baskets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support).orderBy(F.desc("n"), "item")


def top_patterns(baskets: DataFrame, min_support: int = 3, k: int = 50, longest: int | None = None) -> DataFrame:
    """For each frequent item its k patterns with most support: (item, pattern, n, rank). Equal supports: the longer first, then by name.

    Spark's own parallel FP-growth mines; it shares the items out in groups.
    """
    from pyspark.ml.fpm import FPGrowth

    clean = baskets.select(F.array_distinct("items").alias("items")).where(F.size("items") > 0)
    total = clean.count()
    if not total:
        return baskets.sparkSession.createDataFrame([], "item string, pattern array<string>, n long, rank int")
    found = FPGrowth(itemsCol="items", minSupport=(min_support - 0.5) / total).fit(clean).freqItemsets
    if longest:
        found = found.where(F.size("items") <= longest)
    each = found.select(F.explode("items").alias("item"), F.sort_array("items").alias("pattern"), F.col("freq").alias("n"))
    by = Window.partitionBy("item").orderBy(F.desc("n"), F.desc(F.size("pattern")), F.array_join("pattern", ","))
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def pair_supports(baskets: DataFrame, id: str, item: str, min_support: int) -> DataFrame:
    """(a, b, n): pairs of frequent items in at least min_support baskets. Items that are rare by themselves leave before the join."""
    rows = baskets.select(id, item).distinct()
    often = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_support).select(item)
    rows = rows.join(often, item, "left_semi")
    a, b = rows.select(id, F.col(item).alias("a")), rows.select(id, F.col(item).alias("b"))
    return a.join(b, id).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
