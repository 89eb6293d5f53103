"""Rows of a table named by their id and a hash of their text, for the stages that keep some rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's xxhash64 of a string is XXH64 of its UTF-8 bytes with this seed.
SPARK_SEED = 42
SIEVE_BITS = 24  # of a bitmap of ids: 2 MB at any size


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that kept (doc_id, th, n) names; of repeated rows one.

    th is xxhash64 of the text, null as empty; n is the number of rows of docs with that name. Null ids match null ids.
    kept must be cheap to read twice.
    """
    own, free = docs.columns, "_"
    while any(c.lower().startswith(free) for c in own):
        free += "_"
    key_id, key_th, k_id, k_th = (free + x for x in ("id", "th", "kept_id", "kept_th"))
    keyed = docs.withColumn(key_id, F.col("doc_id").cast("long")).withColumn(key_th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    names = kept.select(F.col("doc_id").alias(k_id), F.col("th").alias(k_th))
    found = keyed.join(names, F.col(key_id).eqNullSafe(F.col(k_id)) & (F.col(key_th) == F.col(k_th)), "left_semi")
    if not kept.where("n > 1").isEmpty():
        found = found.dropDuplicates([key_id, key_th])
    return found.select(*[F.col(f"`{c}`") for c in own])


def sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of the rows whose doc_id is not in ids, by a bitmap of hashes that is of the same size for any number of ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE_BITS))
    bitmap = ids.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("_b")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(32767)).alias("_map"))
    found = docs.withColumn("_h", place).withColumn("_b", F.shiftright("_h", 15)).join(F.broadcast(bitmap), "_b")  # at most 512 rows of 4 kB
    byte = F.conv(F.hex(F.expr("substring(_map, CAST((_h & 32767) div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    return found.where(F.call_function("bit_get", byte, F.expr("CAST(_h & 7 AS int)")) == 1).select(docs.columns)
