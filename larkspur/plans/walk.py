"""Random walk on a bipartite graph, by classes of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.matrix import atb, l1_normalise, transpose
from larkspur.operators.topk import topk_rows
from larkspur.session import written


def random_walk(edges: DataFrame, iterations: int = 1, gamma: float = 1e-8, classes: DataFrame | None = None, legacy_orientation: bool = False, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges: user, item, weight. Returns class weights of users and of items, both (row, col = class, value).

    classes: item, class (and weight, else 1); without it each item is a class of its own, which grows dense: give coarse
    classes where there are many items. An iteration takes the classes over to users and back to items, by edges that are
    normalised per user and per item; weights under gamma are dropped each time. start: item weights to go on from.
    legacy_orientation: from the second iteration on, item weights are used with rows and columns exchanged.
    """
    cells = edges.groupBy(F.col("user").alias("row"), F.col("item").alias("col")).agg(F.sum("weight").alias("value")).where("value <> 0")
    v = written(transpose(l1_normalise(cells)), "walk-v")  # item, user: atb joins on the item
    w = written(transpose(l1_normalise(transpose(cells))), "walk-w")  # user, item: joins on the user
    if start is not None:
        items = start
    elif classes is None:
        items = cells.select(F.col("col").alias("row")).distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
    else:
        weight = F.col("weight") if "weight" in classes.columns else F.lit(1.0)
        items = classes.select(F.col("item").alias("row"), F.col("class").alias("col"), weight.alias("value"))
    users = None
    for i in range(iterations):
        users = written(atb(v, transpose(items) if legacy_orientation and i else items, gamma), "walk-users")
        items = written(atb(w, users, gamma), "walk-items")
    return users, items


def walk_lists(edges: DataFrame, users: DataFrame, items: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The k best classes of each user, with the weight of the direct edge or -1, and the k best items of each class."""
    direct = edges.groupBy(F.col("user").alias("row"), F.col("item").alias("col")).agg(F.min("weight").alias("edge"))
    best = topk_rows(users, k).join(direct, ["row", "col"], "left").withColumn("edge", F.coalesce("edge", F.lit(-1.0)))
    return best, topk_rows(transpose(items), k)
