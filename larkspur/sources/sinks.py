"""Writers: text, sorted tables, a folder per value, key-value stores."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.delimited import as_lines


def write_text(df: DataFrame, path: str) -> None:
    as_lines(df).write.mode("overwrite").text(path)


def write_by_value(df: DataFrame, column: str, path: str) -> None:
    """A folder for each value of a column, such as a column's name or a fold."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_sorted(df: DataFrame, key: str, path: str, parts: int | None = None) -> None:
    """Files in the order of the key, sorted inside: a lookup by key reads the row groups whose range holds it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, keys: Iterable) -> DataFrame:
    """The rows of some keys; the filter goes down to the files."""
    return spark.read.parquet(path).where(F.col(key).isin(list(keys)))


def write_string(spark: SparkSession, path: str, text: str) -> None:
    """A file of its own with this text, such as statistics of a run; an existing one is replaced."""
    place, fs = _file(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_string(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def delete_parts(spark: SparkSession, folder: str, prefix: str = "part") -> int:
    """Deletes a folder's files whose name starts with the prefix, and tells how many they were."""
    place, fs = _file(spark, folder)
    found = [x.getPath() for x in fs.listStatus(place) if x.isFile() and x.getPath().getName().startswith(prefix)] if fs.exists(place) else []
    for x in found:
        fs.delete(x, False)
    return len(found)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; fails where the source is missing or the target is there."""
    (a, fs), (b, _) = _file(spark, source), _file(spark, target)
    if fs.exists(b) or not fs.exists(a) or not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def compact_sorted(spark: SparkSession, source: str, key: str, target: str, parts: int | None = None) -> None:
    """write_sorted() of a Parquet folder into another name, after which the source is deleted."""
    write_sorted(spark.read.parquet(source), key, target, parts)
    place, fs = _file(spark, source)
    fs.delete(place, True)


class KeyValueStore(Protocol):
    """What a store must offer; opened once in each task, on the executor. Records are sent and asked for several at a time."""

    def put(self, records: list[tuple[str, dict[str, str]]]) -> None: ...

    def get(self, keys: list[str]) -> list[dict[str, str]]: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...


class FileStore:
    """Lines of key, name and value in a file of its own, read back from all files of the folder; a stand-in for a store, and an example of one."""

    def __init__(self, folder: str):
        self.folder, self.file = folder, None

    def put(self, records: list[tuple[str, dict[str, str]]]) -> None:
        import uuid

        if self.file is None:
            os.makedirs(self.folder, exist_ok=True)
            self.file = open(os.path.join(self.folder, uuid.uuid4().hex), "w")
        self.file.writelines(f"{key}\t{n}\t{v}\n" for key, values in records for n, v in values.items())

    def get(self, keys: list[str]) -> list[dict[str, str]]:
        found: dict[str, dict[str, str]] = {k: {} for k in keys}
        for name in sorted(os.listdir(self.folder)):
            with open(os.path.join(self.folder, name)) as f:
                for line in f:
                    key, n, v = line.rstrip("\n").split("\t")
                    if key in found:
                        found[key][n] = v
        return [found[k] for k in keys]

    def flush(self) -> None:
        if self.file is not None:
            self.file.flush()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_rows(cells: DataFrame, opened, family: str = "vector", go: int = 500) -> None:
    """Each matrix row as one record, named by columns; opened() gives a KeyValueStore in each task, which gets `go` records at a time.

    Putting a record twice must be harmless, as tasks may be run again.
    """
    rows = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("string"), F.col("value").cast("string")))).alias("cells"))

    def put(part) -> None:
        store = opened()
        try:
            while some := list(itertools.islice(part, go)):
                store.put([(str(r["row"]), {f"{family}:{n}": v for n, v in r["cells"].items()}) for r in some])
            store.flush()
        finally:
            store.close()

    rows.foreachPartition(put)


def fetch_rows(keys: DataFrame, key: str, opened, names: list[str], go: int = 500) -> DataFrame:
    """keys with a text column for each name of their record in a store (null where it has none); `go` keys are asked for at a time."""
    schema = ", ".join([f"`{c}` {keys.schema[c].dataType.simpleString()}" for c in keys.columns] + [f"`{n}` string" for n in names])

    def get(frames):
        store = opened()
        try:
            for frame in frames:
                found = [r for i in range(0, len(frame), go) for r in store.get([str(k) for k in frame[key][i : i + go]])]
                yield frame.assign(**{n: [r.get(n) for r in found] for n in names})
        finally:
            store.close()

    return keys.mapInPandas(get, schema)
