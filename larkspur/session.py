"""Spark sessions and the few settings the operators care about."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | str = "*", memory: str = "6g", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this machine on a local master, and an error on a cluster, whose machines do not see each other's folders."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = jdir.get() if jdir.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


_open = threading.local()


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage; a lost executor loses nothing of it.

    Inside scratch() the table goes at the end of that block, unless keep is set. drop_all() removes what is left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    blocks = getattr(_open, "blocks", [])
    if blocks and not keep:
        blocks[-1].append(path)
    elif len(blocks) > 1:  # kept beyond its own block, not beyond the one around it
        blocks[-2].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that written() made, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/larkspur/" in f:
            _delete(df.sparkSession, f)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes in this block are deleted at its end; what leaves the block is written with keep."""
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    _open.blocks.append([])
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            _delete(spark, path)


def drop_all(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder; for when its results are stored."""
    _delete(spark, f"{shared_folder(spark)}/larkspur/{spark.sparkContext.applicationId}")


def broadcast_if_small(df, most: int = 64 << 20):
    """df with a broadcast hint if Catalyst's estimate of its size is at most `most` bytes; else as it is, for a shuffle join."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df
