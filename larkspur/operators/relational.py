"""Selection, filters, counts, distinct values, sums and overlaps of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.splits import uniform


def log_transform(x: Column | str) -> Column:
    """ln(x + 1) + 1."""
    return F.log1p(F.col(x) if isinstance(x, str) else x) + 1


def select_columns(df: DataFrame, columns: list[int | str], log: int | str | None = None) -> DataFrame:
    """Columns by place or name, in the order given; places out of range are skipped. A repeated column gets a numbered name.

    log: a column whose values become ln(x + 1) + 1.
    """
    names = [df.columns[c] if isinstance(c, int) else c for c in columns if not isinstance(c, int) or 0 <= c < len(df.columns)]
    log = df.columns[log] if isinstance(log, int) else log
    out, seen = [], {}
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        value = log_transform(F.col(n).try_cast("double")) if n == log else F.col(n)
        out.append(value.alias(n if seen[n] == 1 else f"{n}_{seen[n]}"))
    return df.select(*out)


def log_last(df: DataFrame, column: str | None = None) -> DataFrame:
    """The log transform of a column, by default the last."""
    c = column or df.columns[-1]
    return df.withColumn(c, log_transform(F.col(c).try_cast("double")))


def filter_input(df: DataFrame, user: str, item: str, denied: DataFrame | None = None, prefixes: tuple[str, ...] = ("R", "H"), least: int = 0) -> DataFrame:
    """Rows whose item is neither denied (first column) nor starts with a prefix, of users with at least `least` such rows."""
    out = df
    if denied is not None:
        out = out.join(denied.select(F.col(denied.columns[0]).alias("_denied")).distinct(), F.col(item) == F.col("_denied"), "left_anti")
    for p in prefixes:
        out = out.where(~F.col(item).cast("string").startswith(p))
    if least > 0:
        # Counted and joined back rather than by a window, so that a user with many rows is no single task's work.
        out = out.join(out.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n"), user, "left_semi")
    return out


def prune(cells: DataFrame, threshold: float = 0.0, value: str = "value") -> DataFrame:
    """Cells at or above the threshold."""
    return cells.where(F.col(value) >= threshold)


def sample_users(df: DataFrame, user: str, share: float = 0.01, seeds: DataFrame | None = None, seed: int = 17, kind: str = "xx") -> DataFrame:
    """Rows of a share of the users, chosen by a hash of the user, and of the users in seeds (first column)."""
    chance = uniform(user, seed=seed, kind=kind) < share
    if seeds is None:
        return df.where(chance)
    own = seeds.select(F.col(seeds.columns[0]).alias(user)).distinct().withColumn("_seed", F.lit(True))
    return df.join(own, user, "left").where(chance | F.col("_seed")).drop("_seed")


def key_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_columns(df: DataFrame, columns: list[int | str]) -> DataFrame:
    """(column, value): the distinct values of each column, as strings, in one pass. Places out of range are skipped."""
    names = [df.columns[c] if isinstance(c, int) else c for c in columns if not isinstance(c, int) or 0 <= c < len(df.columns)]
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names])
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.value").distinct()


def column_sums(df: DataFrame, columns: list[str], exclude: bool = False) -> DataFrame:
    """The row count and the sum of each column, or of all others."""
    names = [c for c in df.columns if (c in columns) != exclude]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in names])


def row_average(cells: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """Mean of each row's cells other than zero."""
    return cells.where(F.col(value) != 0).groupBy(row).agg(F.avg(value).alias("average"))


def item_counts(cells: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """Number of each row's cells other than zero."""
    return cells.where(F.col(value) != 0).groupBy(row).agg(F.count(F.lit(1)).alias("n"))


def union_all(*tables: DataFrame, tag: str | None = None) -> DataFrame:
    """All rows of all tables; tag: a column for the table's number."""
    tagged = [t.withColumn(tag, F.lit(i)) for i, t in enumerate(tables)] if tag else tables
    return reduce(lambda a, b: a.unionByName(b), tagged)


def jaccard(tables: list[DataFrame], key: str, value: str, strict: bool = False) -> DataFrame:
    """Of each key that all tables have: its values, those in common, and their ratio.

    A value is common if it occurs more than once over all tables; strict: if every table has it.
    """
    rows = union_all(*[t.select(key, value) for t in tables], tag="_t")
    by_value = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.collect_set("_t").alias("ts"))
    common = (F.size("ts") == len(tables)) if strict else (F.col("n") > 1)
    # A set of at most as many numbers as there are tables.
    by_key = by_value.groupBy(key).agg(
        F.sum(common.cast("long")).alias("common"), F.count(F.lit(1)).alias("total"), *[F.max(F.array_contains("ts", i)).alias(f"_{i}") for i in range(len(tables))]
    )
    in_all = reduce(lambda a, b: a & b, [F.col(f"_{i}") for i in range(len(tables))])
    return by_key.where(in_all).select(key, "common", "total", (F.col("common") / F.col("total")).alias("jaccard"))


def jaccard_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("jaccard").alias("mean"))
