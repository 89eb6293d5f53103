"""Why an item is recommended: the rated item that speaks most for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.vectors import prefix_ratio


def reasons(recs: DataFrame, rated: DataFrame, similar: DataFrame, meta: DataFrame, sim_weight: float = 1.0, cat_weight: float = 1.0) -> DataFrame:
    """recs (user, item, score) with reason (a rated item) and kind: SIMILARITY, CATEGORY or RANDOM.

    A rated item counts sim_weight + similarity if similar (item, other, similarity) lists it for the recommended item, and
    cat_weight times the share of the category (meta: item, category) that both start with. The highest over zero wins, of
    equal ones the lowest id; without one the lowest rated id is taken, as good as any.
    """
    pairs = recs.select("user", "item", "score").join(rated.select("user", F.col("item").alias("other")).distinct(), "user")
    pairs = pairs.join(similar.select("item", "other", "similarity"), ["item", "other"], "left")
    pairs = pairs.join(meta.select("item", F.col("category").alias("c1")), "item", "left").join(meta.select(F.col("item").alias("other"), F.col("category").alias("c2")), "other", "left")
    sim = F.when(F.col("similarity").isNotNull(), sim_weight + F.col("similarity")).otherwise(0.0)
    points = sim + F.coalesce(cat_weight * prefix_ratio(F.col("c1"), F.col("c2")), F.lit(0.0))
    best = pairs.withColumn("points", points).groupBy("user", "item", "score").agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("other").alias("o"))).alias("b"))
    kind = F.when(-F.col("b.p") >= sim_weight, "SIMILARITY").when(-F.col("b.p") > 0, "CATEGORY").otherwise("RANDOM")
    return best.select("user", "item", "score", F.col("b.o").alias("reason"), kind.alias("kind"))


def association_similarity(rules: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rules (item, other, similarity) by name to the same by id."""
    from larkspur.operators.indexing import encode

    return encode(rules, {"item": dictionary, "other": dictionary})


def als_reasons(recs: DataFrame, rated: DataFrame, factors: DataFrame, gram: np.ndarray, reg: float, alpha: float = 40.0, places: int = 12) -> DataFrame:
    """(user, item, reason): the rated item i with the highest y_i' W^-1 y_j, W = Y'Y + Y'(C - I)Y + reg I of the user; -1 without one over zero.

    Values are compared as rounded to `places` decimals, so that neither noise nor the order of summation decides; of equal
    ones the lowest id wins. rated: user, item, rating. A user's rated items and recommendations are gathered as arrays: as
    many as the user has.
    """
    side = factors.select(F.col("id").alias("item"), "f")
    own = rated.join(side, "item").groupBy("user").agg(F.collect_list(F.struct("item", F.col("rating").cast("double").alias("rating"), "f")).alias("own"))
    asked = recs.select("user", "item").join(side, "item").groupBy("user").agg(F.collect_list(F.struct("item", "f")).alias("asked"))
    k = gram.shape[0]

    def columns(of: pa.ListArray) -> tuple[np.ndarray, pa.StructArray, np.ndarray, np.ndarray]:
        held = of.flatten()
        ends = np.concatenate([[0], np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return ends, held, held.field("item").to_numpy(zero_copy_only=False), held.field("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (at, held, ids, y), (asked_at, _, items, x) = columns(b.column("own")), columns(b.column("asked"))
            c = alpha * held.field("rating").to_numpy(zero_copy_only=False)
            reason = np.empty(len(items), np.int64)
            for lo, hi, first, last in zip(at, at[1:], asked_at, asked_at[1:]):
                order = lo + np.argsort(ids[lo:hi])
                z = y[order]
                w = gram + (z * c[order, None]).T @ z + reg * np.eye(k)
                s = np.round(z @ np.linalg.solve(w, x[first:last].T), places)
                reason[first:last] = np.where(s.max(axis=0) > 0, ids[order][s.argmax(axis=0)], -1)
            users = np.repeat(b.column("user").to_numpy(zero_copy_only=False), np.diff(asked_at))
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(items, pa.int64()), pa.array(reason)], ["user", "item", "reason"])

    return own.join(asked, "user").select("user", "own", "asked").mapInArrow(run, "user long, item long, reason long")
