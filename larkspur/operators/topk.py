"""The best cells of each row, and ranks within a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(cells: DataFrame, row: str = "row", col: str = "col", value: str = "value", rank: str = "rank") -> DataFrame:
    """1 for a row's highest value; equal values by column."""
    return cells.withColumn(rank, F.row_number().over(Window.partitionBy(row).orderBy(F.desc(value), F.asc(col))))


def topk_rows(cells: DataFrame, k: int, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """The k highest cells of each row. Spark keeps k rows a group before the shuffle, so hot rows shrink there."""
    return ranked(cells, row, col, value).where(F.col("rank") <= k)


def topk_wide(cells: DataFrame, k: int, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """A row's k highest cells as one array of (col, value), highest first."""
    top = topk_rows(cells, k, row, col, value)
    return top.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", col, value))), lambda x: F.struct(x[col].alias(col), x[value].alias(value))).alias("top"))


def wide_text(wide: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """The wide form as text: col,value,col,value..."""
    return wide.select(row, F.array_join(F.transform("top", lambda x: F.concat_ws(",", x[col].cast("string"), x[value].cast("string"))), ",").alias("record"))


def minmax_scores(cells: DataFrame, most: float | None = None, row: str = "row", value: str = "value") -> DataFrame:
    """Each row's values brought to 0.5 to 1 between its lowest and highest (unchanged if they are equal), then at most `most`.

    Bounds are summed up by task and joined, so a row of very many cells need not meet in one task.
    """
    bounds = cells.groupBy(F.col(row).alias("_row")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high == low, F.col(value)).otherwise((F.col(value) - low) / (high - low) * 0.5 + 0.5)
    out = cells.join(bounds, F.col(row).eqNullSafe(F.col("_row")))
    return out.withColumn(value, scaled if most is None else F.least(scaled, F.lit(float(most)))).select(*cells.columns)
