"""Alternating least squares, explicit and implicit.

A half-step solves one small system per row of one side. Ratings are dealt by that side and sorted by it, so a task adds
up each row's system as it reads, one matrix product a row, for any number of features, and holds one row at a time. A
row of over HOT ratings is dealt to several tasks; their sums, which are few, meet in a second step. Factors of the other
side are broadcast while they are under BROADCAST_BYTES, after the ratings are dealt, and joined before that beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import broadcast_if_small, drop_written, written

BROADCAST_BYTES, HOT, GO = 128 << 20, 200_000, 256


def _factor_rows(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def dealt(ratings: DataFrame, own: str, other: str) -> tuple[DataFrame, bool]:
    """ratings with _parts, the number of tasks that a row of one side is dealt to, and _part; and whether any has more than one."""
    counts = ratings.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("_parts")).where("_parts > 1")
    if counts.isEmpty():
        return ratings.withColumns({"_parts": F.lit(1), "_part": F.lit(0)}), False
    joined = ratings.join(broadcast_if_small(written(counts, "als-hot")), own, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    return joined.withColumn("_part", F.pmod(F.xxhash64(other), "_parts").cast("int")), True


def gram(factors: DataFrame, k: int) -> np.ndarray:
    """Y'Y: k x k numbers, summed per task, then in a few tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = _factor_rows(b.column(0), k)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    sums = factors.select("f").mapInArrow(partial, "s binary").repartition(8).mapInArrow(merge, "s binary").collect()  # 8 rows
    return sum((np.frombuffer(r["s"]) for r in sums), np.zeros(k * k)).reshape(k, k)


def half_step(ratings: DataFrame, factors: DataFrame, own: str, other: str, k: int, reg: float, alpha: float = 40.0, implicit: bool = False, strategy: str | None = None) -> DataFrame:
    """(id, f) of one side from the other's. Implicit: (Y'Y + Y'(C - I)Y + reg I) x = Y'Cp with confidence 1 + alpha r; explicit: reg times the number of ratings."""
    rows, hot = dealt(ratings.select(own, other, "rating"), own, other)
    small = strategy == "broadcast" or (strategy is None and 8 * factors.count() * k <= BROADCAST_BYTES)
    side = factors.select(F.col("id").alias(other), "f")
    if not small:
        rows = rows.join(side, other)
    rows = rows.repartition(own, "_part")
    if small:
        rows = rows.join(F.broadcast(side), other)
    base = gram(factors, k) if implicit else np.zeros((k, k))

    def solved(ids: list[int], sums: list[np.ndarray]) -> np.ndarray:
        s = np.stack(sums)
        a = s[:, : k * k].reshape(-1, k, k) + base + np.eye(k) * (reg if implicit else (reg * s[:, -1])[:, None, None])
        return np.linalg.solve(a, s[:, k * k : k * k + k, None])[..., 0]

    def out(ids: list[int], sums: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        f = _arrays(solved(ids, sums)) if whole else pa.nulls(len(ids), pa.list_(pa.float64()))
        parts = pa.nulls(len(ids), pa.binary()) if whole else pa.array([s.tobytes() for s in sums], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), f, parts], ["id", "f", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[bool, tuple[list[int], list[np.ndarray]]] = {True: ([], []), False: ([], [])}
        at, whole, held = None, True, None

        def close() -> Iterator[pa.RecordBatch]:
            ids, sums = done[whole]
            ids.append(at[0])
            sums.append(held)
            if len(ids) >= GO:
                yield out(ids, sums, whole)
                done[whole] = ([], [])

        for b in batches:
            if not b.num_rows:
                continue
            ids, part, parts = (b.column(c).to_numpy(zero_copy_only=False) for c in (own, "_part", "_parts"))
            y, r = _factor_rows(b.column("f"), k), b.column("rating").to_numpy(zero_copy_only=False).astype(float)
            weight, right = (alpha * r, 1 + alpha * r) if implicit else (np.ones(len(r)), r)
            cut = np.flatnonzero((ids[1:] != ids[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ids)]):
                key, z = (int(ids[lo]), int(part[lo])), y[lo:hi]
                s = np.concatenate([((z * weight[lo:hi, None]).T @ z).ravel(), right[lo:hi] @ z, [hi - lo]])
                if key == at:
                    held += s
                    continue
                if at is not None:
                    yield from close()
                at, whole, held = key, parts[lo] == 1, s
        if at is not None:
            yield from close()
        for kind, (ids, sums) in done.items():
            if ids:
                yield out(ids, sums, kind)

    rows = rows.select(own, "_part", "_parts", F.col("rating").cast("double").alias("rating"), "f").sortWithinPartitions(own, "_part")
    first = rows.mapInArrow(add, "id long, f array<double>, s binary")
    if not hot:
        return first.select("id", "f")
    first = written(first, "als-parts")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for i, s in zip(b.column("id").to_pylist(), b.column("s").to_pylist()):
                if i != at and at is not None:
                    yield out([at], [held], True)
                at, held = i, np.frombuffer(s) + (held if i == at else 0)
        if at is not None:
            yield out([at], [held], True)

    few = first.where("s IS NOT NULL").repartition("id").sortWithinPartitions("id").mapInArrow(meet, "id long, f array<double>, s binary")
    return first.where("s IS NULL").select("id", "f").union(few.select("id", "f"))


def initial_items(ratings: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """Mean rating first, the others between 0 and 1 from a hash of the item."""
    rest = [F.pmod(F.xxhash64("item", F.lit(seed * 1000 + x)), F.lit(1 << 52)) / F.lit(float(1 << 52)) for x in range(1, k)]
    return ratings.where("rating <> 0").groupBy("item").agg(F.avg("rating").alias("m")).select(F.col("item").alias("id"), F.array("m", *rest).alias("f"))


def movement(new: DataFrame, old: DataFrame) -> tuple[int, float]:
    """The number of rows and the sum of squared differences."""
    both = new.alias("n").join(old.select("id", F.col("f").alias("g")), "id")
    d = F.aggregate(F.zip_with("f", "g", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    n, total = both.agg(F.count(F.lit(1)), F.sum(d)).first()
    return n, float(total or 0.0)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, folder: str) -> list[int]:
    """The iterations whose factors of both sides stand in a folder, ascending."""
    place, fs = _hadoop(spark, folder)
    if not fs.exists(place):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(place)]
    whole = lambda n: all(_hadoop(spark, f"{folder}/{n}/{side}/_SUCCESS")[1].exists(_hadoop(spark, f"{folder}/{n}/{side}/_SUCCESS")[0]) for side in ("users", "items"))
    return sorted(int(n[10:]) for n in names if n.startswith("iteration-") and whole(n))


def factorise(
    ratings: DataFrame, k: int, iterations: int, reg: float, implicit: bool = False, alpha: float = 40.0, items: DataFrame | None = None, strategy: str | None = None, curve: bool = False, log: bool = False,
    folder: str | None = None, start: int | None = None,
) -> tuple[DataFrame, DataFrame, list[tuple[int, int, float, int, float]]]:
    """ratings: user, item, rating. Users' and items' factors (id, f) and, with curve, how far both moved in each iteration.

    items: factors to go on from. log: ratings become ln(x + 1) + 1 first. Each half-step is written to the shared folder,
    and an iteration's factors are deleted once the next one's are there. folder: where each iteration's factors go instead;
    a call that finds some there goes on after the last whole iteration, or after iteration start - 1 if start is given.
    """
    spark = ratings.sparkSession
    value = F.log1p("rating") + 1 if log else F.col("rating")
    cells = written(ratings.groupBy("user", "item").agg(F.sum("rating").alias("rating")).where("rating <> 0").select("user", "item", value.cast("double").alias("rating")), "als-ratings")
    users, moved, first = None, [], 0
    if folder and (done := [n for n in finished(spark, folder) if start is None or n < start]):
        first = done[-1] + 1
        users, items = (spark.read.parquet(f"{folder}/iteration-{done[-1]}/{side}") for side in ("users", "items"))
    else:
        items = written(items if items is not None else initial_items(cells, k), "als-items")

    def store(df: DataFrame, side: str, n: int) -> DataFrame:
        if not folder:
            return written(df, f"als-{side}")
        path = f"{folder}/iteration-{n}/{side}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    for n in range(first, iterations):
        new_users = store(half_step(cells, items, "user", "item", k, reg, alpha, implicit, strategy), "users", n)
        new_items = store(half_step(cells, new_users, "item", "user", k, reg, alpha, implicit, strategy), "items", n)
        if curve:
            moved.append((n, *(movement(new_users, users) if users is not None else (new_users.count(), 0.0)), *movement(new_items, items)))
        for old in (users, items) if not folder else ():
            if old is not None:
                drop_written(old)
        if folder and n:
            place, fs = _hadoop(spark, f"{folder}/iteration-{n - 1}")
            fs.delete(place, True)
        users, items = new_users, new_items
    return users, items, moved


def rmse(ratings: DataFrame, users: DataFrame, items: DataFrame, implicit: bool = False, alpha: float = 40.0) -> float:
    """Root mean squared error; implicit: of the preference, weighted by confidence."""
    x = ratings.join(users.select(F.col("id").alias("user"), F.col("f").alias("u")), "user").join(items.select(F.col("id").alias("item"), F.col("f").alias("v")), "item")
    guess = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    want, weight = (F.when(F.col("rating") > 0, 1.0).otherwise(0.0), 1 + alpha * F.col("rating")) if implicit else (F.col("rating"), F.lit(1.0))
    return float(x.select((weight * (guess - want) * (guess - want)).alias("e"), weight.alias("w")).agg(F.sqrt(F.sum("e") / F.sum("w"))).first()[0])
