"""Shared helpers of the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import drop_written, scratch, written

__all__ = ["ASCII_SPACE", "by_batch", "crc_column", "crc_text", "drop_written", "id_text", "scratch", "table", "written"]

ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, setup: Callable | None = None) -> DataFrame:
    """df through f, an Arrow batch at a time; setup() runs once in each task and goes to f as its second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows and (out := f(batch, *held)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """The two columns the text operators read; other columns, whatever their names, stay out. Null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def crc_text(doc_id: int | None) -> int:
    """crc32 of doc_id written as decimal text; null as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


def crc_column(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
