"""The operators that work on streams: lookups against static tables, filters, running counts, and sinks by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.joins import Target, lookup_join


def stream_lookup(stream: DataFrame, key: list[str], targets: list[Target], default: object = "null") -> DataFrame:
    """lookup_join with a stream as source; the targets are static."""
    return lookup_join(stream, key, targets, default)


def windowed_count(stream: DataFrame, time: str, key: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per key and window of event time; rows later than `late` behind the latest are dropped, and state goes with them."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """A query that gives each batch to write; with all that has come so far, then it ends. write must be harmless when a batch comes again."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
