"""Min-hash clusters of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def _linear(x: Column, i: Column) -> Column:
    """An arithmetic family: (a * x + b) mod a prime, with a and b from the function's number; x under the prime."""
    a, b = i * 1_103_515_245 % PRIME + 1, (i * 12_345 + 7) * 2_654_435 % PRIME
    return F.pmod(a * F.pmod(x.cast("long"), F.lit(PRIME)) + b, F.lit(PRIME))


def _mixed(x: Column, i: Column) -> Column:
    return F.xxhash64(x, i)


HASHES = {"linear": _linear, "murmur": lambda x, i: F.hash(x, i).cast("long"), "xx": _mixed}


def minhash_clusters(sets: DataFrame, id: str, element: str, hashes: int = 20, group: int = 4, kind: str = "linear", min_set: int = 0, min_cluster: int = 0, debug: bool = False) -> DataFrame:
    """(cluster, id) for each of the hash functions: a cluster is named by `group` least hashes in a row, the last ones followed by the first.

    sets: a row per id and element. Sets of fewer than min_set elements and clusters of fewer than min_cluster are left out;
    debug adds the sets' elements.
    """
    distinct = sets.select(id, element).distinct()
    numbered = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: HASHES[kind](F.col(element), i.cast("long")))
    least = distinct.withColumn("_h", numbered).groupBy(id).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.col("_h")[i]).alias(f"_{i}") for i in range(hashes)]).where(F.col("_n") >= min_set)
    names = F.array(*[F.concat_ws("-", *[F.col(f"_{(i + j) % hashes}").cast("string") for j in range(group)]) for i in range(hashes)])
    out = least.select(id, F.explode(F.array_distinct(names)).alias("cluster"))
    if min_cluster > 1:
        big = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_cluster)
        out = out.join(big.select("cluster"), "cluster", "left_semi")
    if debug:
        out = out.join(distinct.groupBy(id).agg(F.sort_array(F.collect_list(element)).alias("elements")), id)
    return out.select("cluster", id, *(["elements"] if debug else []))
