"""Exact dedup by an extendible-hash index on shared files.

A first pass writes, in the shared folder, a row per document: its chunk and its local class in the chunk. The texts of
a chunk that are equal form one local class, and only one of them carries its bytes: a text that a third of all rows
repeat reaches its bucket once per chunk. The directory starts with one bucket and doubles while a bucket is overfull;
the counts it needs are of hash prefixes, of which there are at most 2 ** MOST_BITS. Owner tasks take the buckets'
key ranges sorted by hash, chain entries of the same hash and compare their bytes. What they find, an entry per local
class, is written beside the rows and joined back by (chunk, local class).

Defined results: null text counts as empty, all texts of white space alone are equal; of equal texts the row with the
most code points, then the smallest doc_id (null last), then the first read stays, so that of repeated rows exactly one
is kept; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import ASCII_SPACE, by_batch, id_text, scratch, table, written
from larkspur.llm.rows import SPARK_SEED, keep_rows

CAPACITY, MOST_BITS, FIRST_BITS, OWNER_BYTES = 512, 18, 12, 64 << 20
_SPACE = ASCII_SPACE.encode()


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, _SPACE)


class Directory:
    """2 ** depth entries; a bucket is a prefix of as many bits as its local depth, and owns the entries below it."""

    def __init__(self, capacity: int = CAPACITY, most_bits: int = MOST_BITS):
        self.capacity, self.most_bits = capacity, most_bits
        self.depth, self.buckets = 0, [(0, 0)]

    def grow(self, counts: np.ndarray) -> None:
        """counts: rows by hash prefix, for all prefixes of some number of bits. Splits overfull buckets; one that is as deep as the directory doubles it."""
        bits = len(counts).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(counts)])
        todo, fit = self.buckets, []
        while todo:
            p, d = todo.pop()
            if d >= bits or below[(p + 1) << (bits - d)] - below[p << (bits - d)] <= self.capacity:
                fit.append((p, d))
                continue
            self.depth = max(self.depth, d + 1)
            todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        self.buckets = fit

    def overfull(self, counts: np.ndarray) -> bool:
        bits = len(counts).bit_length() - 1
        return bits < self.most_bits and any(d == bits and counts[p] > self.capacity for p, d in self.buckets)

    def entries(self) -> np.ndarray:
        """For each entry the first entry of its bucket: numbers in the order of the key ranges."""
        out = np.zeros(1 << self.depth, np.int64)
        for p, d in self.buckets:
            at = p << (self.depth - d)
            out[at : at + (1 << (self.depth - d))] = at
        return out

    def owners(self, sizes: np.ndarray, least: int, owner_bytes: int = OWNER_BYTES) -> np.ndarray:
        """For each entry its owner: buckets in the order of their keys, cut into ranges of about owner_bytes, at least `least` ranges. sizes: bytes by hash prefix."""
        bits = len(sizes).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(sizes)])
        share = max(1, min(owner_bytes, int(below[-1]) // max(1, least)))
        # Where a bucket starts, in bytes; a directory deeper than the counts shares a prefix's bytes out evenly.
        at = self.entries() * (1.0 / (1 << self.depth)) * (1 << bits)
        low = np.floor(at).astype(np.int64)
        start = below[low] + (at - low) * np.append(sizes, 0)[low]
        return np.unique((start // share).astype(np.int64), return_inverse=True)[1]


def prefix_counts(entries: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and their bytes by hash prefix."""
    found = entries.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("norm") + 64).alias("size")).collect()  # at most 2 ** bits rows
    counts, sizes = np.zeros((2, 1 << bits), np.int64)
    for p, n, size in found:
        counts[p], sizes[p] = n, size
    return counts, sizes


def directory_of(entries: DataFrame, capacity: int = CAPACITY) -> tuple[Directory, np.ndarray]:
    """The directory, and the bytes by hash prefix."""
    counts, sizes = prefix_counts(entries, FIRST_BITS)
    d = Directory(max(capacity, int(counts.sum()) >> (MOST_BITS - 2)))
    d.grow(counts)
    while d.overfull(counts):
        counts, sizes = prefix_counts(entries, min(MOST_BITS, len(counts).bit_length() + 1))
        d.grow(counts)
    return d, sizes


_ROWS = "doc_id long, chunk long, slot int, row int, cp long, sha string, th long, h long, n long, best_cp long, best_id long, best_row int, norm binary"


def _chunk(batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
    """A chunk is an Arrow batch, which Spark bounds in rows and bytes."""
    chunk = TaskContext.get().partitionId() << 24 | at[0]
    at[0] += 1
    slots: dict[bytes, int] = {}
    rows = []
    best: list[tuple[int, bool, int, int]] = []
    count: list[int] = []
    for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
        raw = text.encode("utf-8", "surrogatepass")
        norm = raw.translate(None, _SPACE)
        slot = slots.setdefault(norm, len(slots))
        rank = (-len(text), doc is None, doc or 0, i)
        if slot == len(best):
            best.append(rank)
            count.append(0)
            rows.append([doc, chunk, slot, i, len(text), hashlib.sha256(norm).hexdigest(), xxhash.xxh64_intdigest(raw, SPARK_SEED), xxhash.xxh64_intdigest(norm), norm])
        else:
            rows.append([doc, chunk, slot, i, len(text), None, xxhash.xxh64_intdigest(raw, SPARK_SEED), 0, None])
        best[slot] = min(best[slot], rank)
        count[slot] += 1
    sha = {r[2]: r[5] for r in rows if r[8] is not None}
    col = list(zip(*rows))
    lead = [x is not None for x in col[8]]
    signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
    pick = lambda f: pa.array([f(s) if x else None for s, x in zip(col[2], lead)], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(col[2], pa.int32()), pa.array(col[3], pa.int32()), pa.array(col[4], pa.int64()), pa.array([sha[s] for s in col[2]]), signed(col[6]), signed(col[7])]
        + [pick(lambda s: count[s]), pick(lambda s: -best[s][0]), pick(lambda s: None if best[s][1] else best[s][2]), pick(lambda s: best[s][3]).cast(pa.int32()), pa.array(col[8], pa.binary())],
        [x.split()[0] for x in _ROWS.split(", ")],
    )


_ENTRIES = "bucket long, h long, chunk long, slot int, keep_id long, keep_chunk long, keep_row int, group_size long"


def _own(batches):
    """Entries sorted by hash: chains those of one hash, compares bytes, and gives each local class its group."""
    held, owned, chains = None, None, []

    def close():
        for _, n, best, members in chains:
            for chunk, slot in members:
                yield owned, held, chunk, slot, None if best[1] else best[2], best[3], best[4], n

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], [x.split()[0] for x in _ENTRIES.split(", ")])

    for batch in batches:
        rows = []
        for bucket, h, norm, chunk, slot, n, cp, doc, row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "norm", "chunk", "slot", "n", "best_cp", "best_id", "best_row"))):
            if h != held:
                rows += close()
                held, owned, chains = h, bucket, []
            best = (-cp, doc is None, doc or 0, chunk, row)
            for link in chains:
                if link[0] == norm:
                    link[1] += n
                    link[2] = min(link[2], best)
                    link[3].append((chunk, slot))
                    break
            else:
                chains.append([norm, n, best, [(chunk, slot)]])
        if rows:
            yield out(rows)
    if rows := list(close()):
        yield out(rows)


def indexed(docs: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, the directory (p, bucket, owner: at most 2 ** MOST_BITS rows; p are as many leading bits as the directory is deep) and the index, all written to the shared folder."""
    spark = docs.sparkSession
    rows = written(by_batch(id_text(docs), _chunk, _ROWS, lambda: [0]), "exact-rows")
    entries = rows.where("norm IS NOT NULL")
    d, sizes = directory_of(entries, capacity)
    owner = d.owners(sizes, int(spark.conf.get("spark.sql.shuffle.partitions")), owner_bytes)
    lookup = [(i, int(x), int(o)) for i, (x, o) in enumerate(zip(d.entries(), owner))]
    directory = written(spark.createDataFrame(lookup, "p long, bucket long, owner long").coalesce(1), "exact-directory")
    placed = entries.withColumn("p", _leading(d.depth)).join(F.broadcast(directory), "p")
    owned = placed.repartitionByRange(int(owner.max()) + 1, "owner").sortWithinPartitions("bucket", "h").select("bucket", "h", "norm", "chunk", "slot", "n", "best_cp", "best_id", "best_row")
    return rows, directory, written(owned.mapInArrow(_own, _ENTRIES), "exact-index")


def _leading(depth: int):
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def duplicates(docs: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, th, keep_id, group_size, kept, text_sha256."""
    rows, _, index = indexed(docs, capacity, owner_bytes)
    return rows.select("doc_id", "th", "chunk", "slot", "row", "sha").join(index.drop("bucket", "h"), ["chunk", "slot"]).select(
        "doc_id", "th", "keep_id", "group_size", ((F.col("chunk") == F.col("keep_chunk")) & (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256")
    )


def probe(docs: DataFrame, built: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """doc_id, keep_id (null where the index has no equal text) of new docs against what indexed() gave: the bucket by the directory, the chain by hash, then the bytes."""
    rows, directory, index = built
    depth = directory.count().bit_length() - 1
    asked = by_batch(id_text(docs), _chunk, _ROWS, lambda: [0])
    lead = asked.where("norm IS NOT NULL").withColumn("p", _leading(depth)).join(F.broadcast(directory.select("p", "bucket")), "p").select("bucket", "h", "norm", "chunk", "slot")
    # A group's first entry stands for it, so that a hot group is one row.
    chain = index.groupBy("bucket", "h", "keep_chunk", "keep_row", "keep_id").agg(F.min(F.struct("chunk", "slot")).alias("e")).select("bucket", "h", "keep_id", "e.chunk", "e.slot")
    own = rows.where("norm IS NOT NULL").select("chunk", "slot", F.col("norm").alias("own"))
    chain = chain.join(own, ["chunk", "slot"]).drop("chunk", "slot")
    found = lead.join(chain, ["bucket", "h"]).where("norm = own").select("chunk", "slot", "keep_id")
    return asked.select("doc_id", "chunk", "slot").join(found, ["chunk", "slot"], "left").select("doc_id", "keep_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they are."""
    with scratch(docs.sparkSession):
        named = duplicates(docs).groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        kept = written(named.where("kept").drop("kept"), "exact-kept", keep=True)
    return keep_rows(docs, kept)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).drop("th")
