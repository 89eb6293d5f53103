"""Best-fit packing of token sequences, by bulk-synchronous supersteps.

Documents are tokenised once, in a pass that also cuts the longer ones and ranks each piece among those of its length:
first within the task, then, by a window over the tasks' counts, over all data. Documents and gaps are held in one table
as runs: pieces of one length with ranks in a row, gaps of one size in sequences with numbers in a row. A class of equal
pieces is one run however many there are, so the table has a few thousand rows at any size of the input.

A superstep deals the table by ranges of size and sorts each range. The task of a range sweeps it upwards: documents
wait, and a gap takes the longest that waits, its best fit. Where several runs want the same gaps, ranks decide: the
longest, then the last in rank, go in, and the others go on waiting. What finds nothing inside its range is carried over
the ranges' boundaries in a second sweep, which the first ones have left few runs for; sweeping parts and then what
they leave gives the same as one sweep. Then filled gaps get their new sizes, all is written to the shared folder, and the
next superstep starts from there. As many sequences are opened at the start as the tokens need at least; supersteps take
the documents in bands of falling length (BAND), and open more when a band's documents find no gap. At last each piece
finds its sequence by its length and rank, in a map without a shuffle.

Defined results: null and empty texts are the one id 0; repeated rows are packed once each; an empty table gives an
empty table; other columns of the input are not read. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, id_text, scratch, table, written

SEQUENCE, BAND, RANGES = 2048, 1.5, 8
_RANK_BITS = 44


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Byte-level BPE over the ranks of byte_bpe_50k, which are the ids of byte_bpe_50k.json, with a bounded memory of words.

    A match of the pattern never goes on over a space that follows a character other than white space, so the text is
    cut there, and each part's ids do not depend on the others.
    """

    MOST, LONG = 600_000, 48
    _loose, _cut = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("bytes", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids, four bytes each, lowest first."""
        if self._loose.search(text):
            return b"".join(map(self.part, self._cut.split(text)))
        first, *words = text.split(" ")
        held = self._spaced
        found = [held.get(w) for w in words]
        for i, x in enumerate(found):
            if x is None:
                w = words[i]
                x = found[i] = held.get(w) or self.part(" " + w)
                if len(w) <= self.LONG:
                    if len(held) >= self.MOST:
                        held.clear()
                    held[w] = x
        return self.part(first) + b"".join(found)


_bpe: dict[str | None, ByteBpe] = {}


def byte_bpe(path: str | None = None) -> ByteBpe:
    """One per worker process."""
    if path not in _bpe:
        _bpe[path] = ByteBpe(path)
    return _bpe[path]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: whole sequences at its end, what is left over first."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def tokenised(docs: DataFrame, most: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task), rank (among the task's pieces of that length)."""

    def setup():
        return byte_bpe(path), {}

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        bpe, ranks = state
        part = TaskContext.get().partitionId()
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = bpe.ids(text) + b"\0\0\0\0"
            for k, (start, n) in enumerate(cuts(len(ids) // 4, most)):
                rank = ranks.get(n, 0)
                ranks[n] = rank + 1
                rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, rank))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return by_batch(id_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long", setup)


#: kind: 0 documents (size: length, first: rank), 1 gaps (first: sequence), 2 placed documents (with sequence and offset).
_RUNS = "kind int, size long, first long, n long, sequence long, offset long"


def sweep(runs: list[tuple[int, int, int, int]], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """One sweep upwards over runs (kind, size, first, n): rows of _RUNS, placed ones first, then gaps and documents that found nothing."""
    placed, gaps, waiting = [], [], []
    for kind, size, first, n in sorted(runs, key=lambda r: (r[1], r[0], r[2])):
        if kind == 0:
            waiting.append([size, first, n])
            continue
        while n and waiting:
            length, rank, there = waiting[-1]
            taken = min(n, there)
            placed.append((2, length, rank + there - taken, taken, first, most - size))
            first, n = first + taken, n - taken
            if taken == there:
                waiting.pop()
            else:
                waiting[-1][2] = there - taken
        if n:
            gaps.append((1, size, first, n, -1, -1))
    return placed + gaps + [(0, *w, -1, -1) for w in waiting]


def _swept(most: int, bounds: list[int]):
    """A task's runs through sweep(), range by range (bounds: where ranges start, besides the first); placed runs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, by = [], {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] == 2:
                    out.append(r)
                else:
                    by.setdefault(bisect.bisect_right(bounds, r[1]), []).append(r[:4])
        for own in by.values():
            out += sweep(own, most)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), *[pa.int64()] * 5))], [x.split()[0] for x in _RUNS.split(", ")])

    return run


def superstep(active: DataFrame, most: int, bounds: list[int]) -> DataFrame:
    """Documents and gaps after a superstep: the placed documents, the gaps in their new sizes, the documents that wait."""
    own = sum(((F.col("size") >= x).cast("int") for x in bounds), F.lit(0))
    local = active.repartition(RANGES, own).mapInArrow(_swept(most, bounds), _RUNS)
    carried = local.repartition(1).mapInArrow(_swept(most, []), _RUNS)  # what the ranges left: fewer runs than there are sizes, whatever the input
    left = F.when(F.col("kind") == 2, F.lit(most) - F.col("offset") - F.col("size"))
    filled = F.struct(F.lit(1).alias("kind"), left.alias("size"), F.col("sequence").alias("first"), "n", F.lit(-1).cast("long").alias("sequence"), F.lit(-1).cast("long").alias("offset"))
    own = F.struct("kind", "size", "first", "n", "sequence", "offset")
    return carried.select(F.explode(F.when(left > 0, F.array(own, filled)).otherwise(F.array(own))).alias("r")).select("r.*")


def supersteps(counts: DataFrame, most: int = SEQUENCE, band: float = BAND) -> list[tuple[int, int, int, int, int]]:
    """counts: length, n. Returns runs (length, first rank, documents, first sequence, offset), a few thousand at any size of the input."""
    spark = counts.sparkSession
    none = F.lit(-1).cast("long")
    state = counts.select(F.lit(0).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n", none.alias("sequence"), none.alias("offset"))
    # Ranges of as many runs each, by the sizes of the superstep before.
    shares = [k / RANGES for k in range(1, RANGES)]
    total, longest, bounds = state.agg(F.sum(F.col("size") * F.col("n")), F.max("size"), F.percentile_approx("size", shares)).first()
    if total is None:
        return []
    opened, new, low = 0, -(-total // most), longest / band
    steps: list[DataFrame] = []
    while True:
        if new:
            state = state.unionByName(spark.createDataFrame([(1, most, opened, new, -1, -1)], _RUNS))
            opened += new
        is_doc, inside = F.col("kind") == 0, (F.col("kind") == 0) & (F.col("size") > low)
        waits = is_doc & ~inside
        stepped = superstep(state.where(~waits), most, sorted(set(bounds or ()))).unionByName(state.where(waits))
        seen = Observation()
        watched = stepped.observe(
            seen, F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("placed"), F.max(F.when(is_doc, F.col("size"))).alias("longest"), F.min(F.when(is_doc, F.col("size"))).alias("least"),
            F.sum(F.when(inside, F.col("size") * F.col("n")).otherwise(0)).alias("tokens"),
            F.percentile_approx(F.when((F.col("kind") == 1) | inside, F.col("size")), shares).alias("bounds"),
        )
        steps.append(written(watched.coalesce(1), "packing-step"))
        found, new = seen.get, 0
        bounds = found["bounds"]
        if found["longest"] is None:
            break
        if not found["tokens"]:
            low = found["longest"] / band
        elif not found["placed"]:
            new = -(-found["tokens"] // most)
        # Gaps that no document fits in any more are left behind.
        state = steps[-1].where((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("size") >= found["least"])))
    runs = steps[0]
    for x in steps[1:]:
        runs = runs.unionByName(x)
    return [tuple(r) for r in runs.where("kind = 2").select("size", "first", "n", "sequence", "offset").collect()]


def placed(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """pieces (length, part, rank, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("ahead"))
    with scratch(spark):
        runs = supersteps(written(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "packing-lengths"), most)
    table_of = np.array(sorted(runs), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast((table_of[:, 0] << _RANK_BITS | table_of[:, 1], table_of[:, 1], table_of[:, 3], table_of[:, 4]))
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0))).drop("ahead", "part")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, first, sequence, offset = held.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return by_batch(ranked, run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, most: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(tokenised(docs, most, path), "pieces")
    return placed(pieces, most).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
