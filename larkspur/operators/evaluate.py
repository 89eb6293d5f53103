"""Ranking measures of recommendation lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_RELEVANT = -1.0


def ranked_lists(recs: DataFrame, k: int, user: str = "user", item: str = "item", score: str = "score", flag: str = "flag") -> DataFrame:
    """The first k of each user's recs with rank (from 1), n (length of the user's whole list), hit (flag over -1) and hits so far.

    Lists are cut to k before the shuffle and their lengths counted by task, so a very long list need not meet in one task.
    """
    by = Window.partitionBy(user).orderBy(F.desc(score), F.asc(item))
    first = recs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    lengths = recs.groupBy(F.col(user).alias("_user")).agg(F.count(F.lit(1)).alias("n"))
    hits = first.withColumn("hit", (F.col(flag) > NOT_RELEVANT).cast("int"))
    hits = hits.withColumn("so_far", F.sum("hit").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.join(lengths, F.col(user).eqNullSafe(F.col("_user"))).drop("_user")


def precision(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k


def average_precision(k: int) -> Column:
    return F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("so_far") / F.col("rank")).otherwise(0.0)) / F.least(F.first("item_count"), F.lit(k))


def percentile_rank(k: int, flag: str = "flag", clip_negative: bool = False) -> Column:
    """Mean percentile of the first k, weighted by the flags as they are (or at least 0); the last of them counts as 100. 0 where the weights' sum is under 1e-5."""
    weight = F.greatest(F.col(flag), F.lit(0.0)) if clip_negative else F.col(flag)
    within = F.col("rank") <= k
    last = F.col("rank") == F.least(F.lit(k), F.col("n"))
    percent = F.when(last, 100.0).otherwise(100.0 * (F.col("rank") - 1) / F.col("n"))
    total = F.sum(F.when(within, weight).otherwise(0.0))
    return F.when(total < 1e-5, 0.0).otherwise(F.sum(F.when(within, weight * percent).otherwise(0.0)) / total)


def recall_curve(k: int) -> list[Column]:
    """Hits so far over the user's relevant items at ten steps of k / 10 (one place at least); null beyond the list's end."""
    step = max(1, k // 10)
    return [
        F.when(F.max("n") >= step * i, F.sum(F.when(F.col("rank") <= step * i, F.col("hit")).otherwise(0)) / F.first("item_count")).alias(f"recall_{i}")
        for i in range(1, 11)
        if step * i <= k
    ]


#: Further measures by name: a function of k that gives an aggregate over ranked_lists, which holds a list's first k.
MEASURES: dict[str, Callable[[int], Column]] = {"precision": precision, "map": average_precision, "epr": percentile_rank}


def evaluate(recs: DataFrame, k: int, user: str = "user", **names: str) -> DataFrame:
    """recs: user, item, score, item_count, flag. Each user's item_count, hits in the first k, measures and recall curve."""
    lists = ranked_lists(recs.where(F.col("item_count").isNotNull()), k, user, **names)
    hits = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits")
    return lists.groupBy(user).agg(F.first("item_count").alias("item_count"), hits, *[f(k).alias(n) for n, f in MEASURES.items()], *recall_curve(k))


def stats(evaluated: DataFrame) -> DataFrame:
    """The number of users, sums of counts and means of measures."""
    names = [c for c in evaluated.columns if c in MEASURES or c.startswith("recall_")]
    return evaluated.agg(F.count(F.lit(1)).alias("n_users"), F.sum("item_count").alias("item_count"), F.sum("hits").alias("hits"), *[F.avg(c).alias(c) for c in names])


def recommend_evaluate(recs: DataFrame, probe: DataFrame, k: int = 100) -> DataFrame:
    """recs (user, item, score) against probe (user, item, rating): users without probe rows are left out; a rec in the probe gets its rating as flag, else -1."""
    counts = probe.groupBy("user").agg(F.count(F.lit(1)).alias("item_count"))
    known = probe.groupBy("user", "item").agg(F.min("rating").alias("flag"))
    flagged = recs.join(counts, "user").join(known, ["user", "item"], "left").withColumn("flag", F.coalesce("flag", F.lit(NOT_RELEVANT)))
    return evaluate(flagged, k)
