"""How far a user's ratings lie from the items' means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.matrix import sparse_row_vector_cosine, transpose
from larkspur.operators.relational import row_average


def user_credit(cells: DataFrame) -> DataFrame:
    """(row, distance): cosine distance of each user's ratings to the vector of the items' means (zeros left out)."""
    means = row_average(transpose(cells)).select(F.col("row").alias("col"), F.col("average").alias("value"))
    return sparse_row_vector_cosine(cells, means)
