"""Random and k-fold splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.indexing import sequential_ids


PRIME = 2147483647  # 2 ** 31 - 1


def uniform(*columns: str, seed: int = 11, kind: str = "xx") -> Column:
    """A number in [0, 1) from a hash of the columns: the same for the same row, however often it is worked out.

    kind: xx takes columns of any type; arithmetic takes whole numbers and uses products and remainders alone, so that
    other engines can work out the same numbers.
    """
    if kind == "xx":
        return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    x = F.lit(seed).cast("long")
    for c in columns:
        x = F.pmod(x * 48271 + F.pmod(F.col(c).cast("long"), F.lit(PRIME)), F.lit(PRIME))
        x = F.pmod(x * 1_597_334_677, F.lit(PRIME))
        x = F.pmod(x * x + x * 69621 + 7, F.lit(PRIME))
        x = F.pmod(x * 742_938_285, F.lit(PRIME))
    return x / F.lit(float(PRIME))


def random_split(df: DataFrame, train: float = 0.9, probe: float = 0.1, seed: int = 11, by: list[str] | None = None, kind: str = "xx") -> tuple[DataFrame, DataFrame]:
    """Each row goes to train with chance `train`, to probe with chance `probe`, else to neither. by: columns whose equal values stay together."""
    u = uniform(*(by or df.columns), seed=seed, kind=kind)
    return df.where(u <= train), df.where((u > train) & (u <= train + probe))


def kfold(df: DataFrame, user: str, k: int = 4, order: Column | list[Column] | None = None, seed: int = 11) -> DataFrame:
    """df with fold: each user's rows, shuffled by a hash (or in the order given), in k windows of equal width; the last may be short or empty.

    Rows are range-sorted by user and order, so a user with very many rows is shared out among tasks. Rows without a user
    count as one user's.
    """
    by = order if order is not None else uniform(*df.columns, seed=seed)
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = sequential_ids(df, [F.col(user), *(by if isinstance(by, list) else [by]), F.xxhash64(*hashed)], id="_place")
    own = placed.groupBy(F.col(user).alias("_user")).agg(F.min("_place").alias("_first"), F.ceil(F.count(F.lit(1)) / k).alias("_width"))
    folded = placed.join(own, F.col(user).eqNullSafe(F.col("_user")))
    return folded.select(*df.columns, F.floor((F.col("_place") - F.col("_first")) / F.col("_width")).cast("int").alias("fold"))


def fold(folded: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Train and probe rows of a fold."""
    return folded.where(F.col("fold") != i).drop("fold"), folded.where(F.col("fold") == i).drop("fold")
