"""Sparse matrices as tables of cells (row, col, value); a value of zero is an absent cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.vectors import DISTANCES
from larkspur.operators.topk import topk_rows
from larkspur.session import written

BLOCK_CELLS, AT_ONCE = 3_000_000, 4_000_000  # cells of a block of columns, pairs that a task adds up at once
NONE = -(1 << 63)  # stands for a null column


def from_table(df: DataFrame, row: str, col: str, value: str | None = None, row_type: str = "long") -> DataFrame:
    """Cells of a table; without a value column 1. Rows that don't cast are skipped, equal cells add up."""
    v = F.lit(1.0) if value is None else F.col(value).try_cast("double")
    cells = df.select(F.col(row).try_cast(row_type).alias("row"), F.col(col).try_cast("long").alias("col"), v.alias("value"))
    return vector_sum(cells.where("row IS NOT NULL AND col IS NOT NULL AND value IS NOT NULL"))


def vector_sum(cells: DataFrame) -> DataFrame:
    """Equal cells added; zeros go."""
    return cells.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def vector_merge(cells: DataFrame) -> DataFrame:
    """Of equal cells the greatest."""
    return cells.groupBy("row", "col").agg(F.max("value").alias("value")).where("value <> 0")


def boolean(cells: DataFrame) -> DataFrame:
    """(col, row) with the number of times it occurs: what each column's rows are."""
    return cells.groupBy(F.col("col").alias("row"), F.col("row").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def compact(cells: DataFrame) -> DataFrame:
    """A row per matrix row, its cells as a map."""
    return cells.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cells"))


def spread(rows: DataFrame) -> DataFrame:
    """The reverse of compact."""
    return rows.select("row", F.explode("cells").alias("col", "value")).where("value <> 0")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))


def _over_rows(cells: DataFrame, total: Column) -> DataFrame:
    """cells with the row's total, by an aggregate and a join: a row of any number of cells is not one task's work."""
    return cells.join(cells.groupBy("row").agg(total.alias("_t")), "row")


def random_cells(spark, rows: int, cols: int, seed: int = 3) -> DataFrame:
    """A full matrix of values between 0 and 1 that depend on place and seed alone; for trials."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return cells.withColumn("value", F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)))


def l1_normalise(cells: DataFrame) -> DataFrame:
    """Values over the plain sum of their row."""
    return _over_rows(cells, F.sum("value")).select("row", "col", (F.col("value") / F.nullif("_t", F.lit(0.0))).alias("value"))


def l2_normalise(cells: DataFrame, reverse: bool = False) -> DataFrame:
    """Values over the length of their row; reverse: rows and columns change places in the result."""
    out = _over_rows(cells, F.sqrt(F.sum(F.col("value") * F.col("value")))).select("row", "col", (F.col("value") / F.col("_t")).alias("value"))
    return transpose(out) if reverse else out


def _parts(cells: DataFrame, shared: str, own: str, n: int) -> DataFrame:
    """Cells packed by block of `own` (k, data): columns sorted by own and shared, as bytes of equal place, compressed."""
    dealt = cells.select(F.coalesce(F.col(own).cast("long"), F.lit(NONE)).alias("o"), F.col(shared).cast("long").alias("s"), F.col("value").alias("v")).where("s IS NOT NULL AND v IS NOT NULL")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("o"), F.lit(n)).cast("int")).repartition(n, "k").sortWithinPartitions("k", "o", "s")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "o", "s", "v"))
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            for lo, hi in zip(cut, cut[1:]):
                if lo < hi:
                    planes = b"".join(np.ascontiguousarray(c[lo:hi]).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array([k[lo]], pa.int32()), pa.array([hi - lo], pa.int32()), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())], ["k", "n", "data"])

    return dealt.mapInArrow(pack, "k int, n int, data binary")


def _unpacked(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, shared, value)"""
    each = [np.frombuffer(pa.decompress(data, 24 * n, "zstd", asbytes=True), np.uint8).reshape(3, 8, n) for n, data in parts]
    planes = [np.ascontiguousarray(np.concatenate([x[i] for x in each], axis=1).T) for i in range(3)]
    return tuple(x.view(kind).ravel() for x, kind in zip(planes, (np.int64, np.int64, np.float64)))


def _tile(left, right) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, col, value) of the product of two blocks (own, shared, value), at most about AT_ONCE pairs at a time."""
    (lo, ls, lv), (ro, rs, rv) = left, right
    by = np.argsort(lo, kind="stable")
    lo, ls, lv = lo[by], ls[by], lv[by]
    by = np.argsort(rs, kind="stable")
    rs, rv = rs[by], rv[by]
    cols, code = np.unique(ro[by], return_inverse=True)
    first, last = np.searchsorted(rs, ls), np.searchsorted(rs, ls, "right")

    def pairs(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = last[a:b] - first[a:b]
        at = np.repeat(np.arange(a, b), many)
        other = np.arange(len(at)) + np.repeat(first[a:b] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        return at, code[other], lv[at] * rv[other]

    before = np.concatenate([[0], np.cumsum(last - first)])
    starts = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]])) if len(lo) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(lo))
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(before[ends], before[a] + AT_ONCE, "right")))
        b, i = ends[j - 1], j
        if before[b] - before[a] > AT_ONCE:  # one row of the result alone
            total, there = np.zeros(len(cols)), np.zeros(len(cols), bool)
            while a < b:
                c = max(a + 1, int(np.searchsorted(before, before[a] + AT_ONCE, "right")) - 1)
                c = min(c, b)
                _, other, v = pairs(a, c)
                total += np.bincount(other, v, len(cols))
                there[other] = True
                a = c
            here = np.flatnonzero(there)
            yield np.full(len(here), lo[b - 1]), cols[here], total[here]
            continue
        at, other, v = pairs(a, b)
        if len(at):
            key = (np.searchsorted(starts, at, "right") - 1) * len(cols) + other
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            row, col = np.divmod(key[new], len(cols))
            yield lo[starts[row]], cols[col], np.add.reduceat(v[order], new)


def _by_blocks(a: DataFrame, b: DataFrame, threshold: float | None) -> DataFrame:
    spark, same = a.sparkSession, a is b
    n = a.count() if same else max(a.count(), b.count())
    blocks = max(-(-n // BLOCK_CELLS), min(12, int(spark.conf.get("spark.sql.shuffle.partitions")))) | 1  # odd: each pair of blocks once
    left = written(_parts(a, "row", "col", blocks), "atb")
    right = left if same else written(_parts(b, "row", "col", blocks), "atb")
    steps = F.sequence(F.lit(0), F.lit(blocks // 2 if same else blocks - 1))
    one = left.select(F.col("k").alias("t"), F.lit(-1).alias("step"), "n", "data")
    other = right.select("k", F.explode(steps).alias("step"), "n", "data").select(F.pmod(F.col("k") - F.col("step"), F.lit(blocks)).alias("t"), "step", "n", "data")
    rows = one.unionByName(other).repartitionByRange(blocks, "t").sortWithinPartitions("t", "step")

    def out(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        keep = value != 0 if threshold is None else ~(value < threshold)  # NaN counts as the greatest, as in Spark
        ids = [pa.array(x[keep], pa.int64(), mask=x[keep] == NONE) for x in (row, col)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(value[keep])], ["row", "col", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, mine = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal mine
            if at is None:
                return
            if at[1] < 0:
                mine = (at[0], _unpacked(held))
            elif mine and mine[0] == at[0]:
                for row, col, value in _tile(mine[1], _unpacked(held)):
                    yield out(row, col, value)
                    if same and at[1]:
                        yield out(col, row, value)

        for batch in batches:
            for t, step, n, data in zip(*(batch.column(c).to_pylist() if c != "data" else batch.column(c) for c in ("t", "step", "n", "data"))):
                if (t, step) != at:
                    yield from close()
                    at, held = (t, step), []
                held.append((n, data.as_py()))
        yield from close()

    return rows.mapInArrow(run, "row long, col long, value double")


def atb(a: DataFrame, b: DataFrame, threshold: float | None = None) -> DataFrame:
    """A transposed times B; cells under the threshold go after all is summed.

    Whole numbers as ids and doubles as values are multiplied by blocks of columns: a task adds up its block of A's columns
    times one block of B's after another, so that no pair of a row's cells is a row of a shuffle. B goes to each of the
    blocks (half of it if A is B), packed; a task holds one block of either. Other types are joined and grouped.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    if all(m.schema["value"].dataType.simpleString() == "double" and m.schema["col"].dataType.simpleString() == "bigint" and m.schema["row"].dataType.simpleString() in whole for m in (a, b)):
        return _by_blocks(a, b, threshold)
    out = a.select(F.col("row").alias("_i"), F.col("col").alias("row"), F.col("value").alias("_x")).join(
        b.select(F.col("row").alias("_i"), "col", F.col("value").alias("_y")), "_i"
    )
    out = out.groupBy("row", "col").agg(F.sum(F.col("_x") * F.col("_y")).alias("value"))
    return out.where("value <> 0") if threshold is None else out.where(F.col("value") >= threshold)


def gram(a: DataFrame) -> DataFrame:
    return atb(a, a)


def multiply(a: DataFrame, b: DataFrame, threshold: float | None = None, as_int: bool = False, strategy: int | None = None, block: int = 256) -> DataFrame:
    """A times B in dense blocks: a pair of blocks is multiplied by numpy, their products are added up by cell.

    threshold: cells at or under it go. as_int: values rounded up. strategy: how blocks are shared out is Spark's choice;
    4 asks for the cell-wise join instead of blocks, which suits very sparse input.
    """
    if strategy == 4:
        out = atb(transpose(a), b)
    else:
        def blocks(m: DataFrame, shared: str, own: str, prefix: str) -> DataFrame:
            cell = F.struct(F.pmod(shared, F.lit(block)).cast("int").alias("s"), F.pmod(own, F.lit(block)).cast("int").alias("o"), F.col("value").cast("double").alias("v"))
            packed = m.groupBy(F.floor(F.col(shared) / block).alias("k"), F.floor(F.col(own) / block).alias(f"{prefix}b")).agg(F.collect_list(cell).alias("c"))  # at most block ** 2 cells
            return packed.select("k", f"{prefix}b", *[F.col(f"c.{n}").alias(prefix + n) for n in ("s", "o", "v")])

        pairs = blocks(a, "col", "row", "l").join(blocks(b, "row", "col", "r"), "k")

        def product(frames):
            for f in frames:
                for r in f.itertuples():
                    x, y = np.zeros((block, block)), np.zeros((block, block))
                    np.add.at(x, (r.ls, r.lo), r.lv)
                    np.add.at(y, (r.rs, r.ro), r.rv)
                    z = x.T @ y
                    i, j = np.nonzero(z)
                    yield pd.DataFrame({"row": i + r.lb * block, "col": j + r.rb * block, "value": z[i, j]})

        parts = pairs.mapInPandas(product, "row long, col long, value double")
        out = parts.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")
    if threshold is not None:
        out = out.where(F.col("value") > threshold)
    return out.withColumn("value", F.ceil("value").cast("long")) if as_int else out


def distance_squared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, distance): squared distance of the rows with the same id; a row that one matrix lacks counts as zeros."""
    signed = a.select("row", "col", "value").unionByName(b.select("row", "col", (-F.col("value")).alias("value")))
    cells = signed.groupBy("row", "col").agg(F.sum("value").alias("d"))
    return cells.groupBy("row").agg(F.sum(F.col("d") * F.col("d")).alias("distance"))


def distance_total(distances: DataFrame) -> DataFrame:
    return distances.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("distance").alias("distance"))


def row_vector_distance(rows: DataFrame, vector: list[float], id: str, array: str, measure: str = "cosine") -> DataFrame:
    """(id, distance) of each dense row to one vector, in JVM code."""
    return rows.select(id, DISTANCES[measure](F.col(array), F.array(*[F.lit(float(x)) for x in vector])).alias("distance"))


def sparse_row_vector_cosine(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, distance): cosine distance of each sparse row to a vector (col, value)."""
    length = vector.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l"))
    by_row = cells.join(vector.select("col", F.col("value").alias("_v")), "col", "left").groupBy("row").agg(
        F.sum(F.col("value") * F.coalesce("_v", F.lit(0.0))).alias("_d"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n")
    )
    return by_row.join(F.broadcast(length)).select("row", (1 - F.col("_d") / (F.col("_n") * F.col("_l"))).alias("distance"))  # length: one row


def cooccurrence_topk(cells: DataFrame, k: int) -> DataFrame:
    """For each column the k others that most rows share with it; equal counts by column."""
    seen = cells.select("row", "col").distinct()
    other = seen.select("row", F.col("col").alias("other"))
    counts = seen.join(other, "row").where("col <> other").groupBy("col", "other").agg(F.count(F.lit(1)).alias("n"))
    return topk_rows(counts, k, "col", "other", "n").select("col", "other", "n", "rank")


def to_text(cells: DataFrame, form: str = "vector") -> DataFrame:
    """value: one line per row (row, two tabs, col:value joined by tabs) or, raw, one per cell (row,col,value)."""
    if form == "raw":
        return cells.select(F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"), F.col("value").cast("string")).alias("value"))
    cell = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: F.concat(F.lit("\t"), c["col"].cast("string"), F.lit(":"), c["value"].cast("string")))
    return cells.groupBy("row").agg(F.array_join(cell, "").alias("_c")).select(F.concat(F.col("row").cast("string"), F.lit("\t"), F.col("_c")).alias("value"))


def dense(cells: DataFrame, rows: int, cols: int, most: int = 50_000_000) -> np.ndarray:
    """A matrix on the driver; refuses more than `most` cells."""
    if rows * cols > most:
        raise ValueError(f"{rows} x {cols} cells are too many for the driver")
    out = np.zeros((rows, cols))
    for batch in cells.select("row", "col", "value").toArrow().to_batches():
        out[batch.column("row").to_numpy(), batch.column("col").to_numpy()] = batch.column("value").to_numpy()
    return out


def from_dense(spark, m: np.ndarray) -> DataFrame:
    i, j = np.nonzero(m)
    return spark.createDataFrame(pd.DataFrame({"row": i, "col": j, "value": m[i, j]}), "row long, col long, value double")


def first_row(cells: DataFrame) -> DataFrame:
    """The cells of the lowest row."""
    return cells.join(F.broadcast(cells.agg(F.min("row").alias("row"))), "row")


def max_per(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias("most"))


