"""Line dedup over a suffix array of line ids, by distributed prefix doubling.

A line's id is the place of its first copy; equal lines are told by 128 bits of hash. Doubling names, for each power of
two, the suffixes that share so many lines: a rank table holds each such suffix with the first place of its group, and
lines or runs without a second copy leave the tables. A name is the first place of its group in place of the group's
rank among all suffixes: equality of names is all that doubling asks, and intervals are groups of equal names, so the
order of the suffix array between groups, which no deletion hangs on, is never worked out. The suffixes that share their first l lines are the interval of
the suffix array with longest common prefix l. A descent from the longest power refines these intervals: a suffix that
is not the first of its refined interval moves on with it, as its lines were seen before; the first stays behind, and
stands for its interval there, as all others of it would part with the rest at the same line. So each suffix ends with
the longest run of lines that it shares with an earlier one. A run of MIN_WORDS words or more is deleted there; the
first copy of it stays. Places are ordered by doc_id (null last), then by row, then by line.

A group may hold a third of all rows: groups are only ever aggregated to their first place and size, which is written,
then joined back; the join of two tables by themselves is one that Spark can split where a key is hot.

Defined results: null and empty texts have no lines and come back as they are; rows are told apart even where they are
equal, so the later of repeated rows is deleted like any copy; an empty table gives an empty table; other columns of
the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, drop_written, id_text, scratch, table, written

MIN_WORDS = 20
_LAST, _AFTER = (1 << 63) - 1, 1 << 62  # of null ids: after the highest id, whose own rows come first


def line_ids(rows: DataFrame) -> DataFrame:
    """rows (u, d, text) to u, d, i, h1, h2."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple[int, int, int, int, int]] = []
        for u, d, text in zip(*(batch.column(c).to_pylist() for c in ("u", "d", "text"))):
            if text:
                for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    h = xxhash.xxh3_128_intdigest(line)
                    out.append((u, d, i, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["u", "d", "i", "h1", "h2"])

    return by_batch(rows, run, "u long, d long, i int, h1 long, h2 long")


def _at(p: str, shift) -> F.Column:
    return F.struct(F.col(f"{p}.d").alias("d"), F.col(f"{p}.u").alias("u"), (F.col(f"{p}.i") + shift).cast("int").alias("i"))


def ranks(lines: DataFrame) -> list[DataFrame]:
    """For each power of two, p and r: the places whose so many lines occur more than once, and the first place of the same."""
    named = written(lines.groupBy("h1", "h2").agg(F.min(F.struct("d", "u", "i")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-names")
    levels = [written(lines.join(named, ["h1", "h2"]).select(F.struct("d", "u", "i").alias("p"), "r"), "lines-rank")]
    while not levels[-1].isEmpty():
        half = 1 << (len(levels) - 1)
        left = levels[-1]
        pairs = written(left.join(left.select(_at("p", -half).alias("p"), F.col("r").alias("r2")), "p"), "lines-pairs")
        named = written(pairs.groupBy("r", "r2").agg(F.min("p").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-names")
        levels.append(written(pairs.join(named, ["r", "r2"]).select("p", F.col("name").alias("r")), "lines-rank"))
        drop_written(pairs)
    return levels[:-1]


def seen_before(levels: list[DataFrame]) -> list[DataFrame]:
    """p, n: the first n lines from place p occur earlier too; for each p the longest such n is among the rows."""
    state = levels[0].select("p", F.col("p").alias("g"), F.lit(0).alias("l"))  # at length 0 all are one interval; g plays no part
    root = F.struct(F.lit(-1).cast("long").alias("d"), F.lit(-1).cast("long").alias("u"), F.lit(-1).alias("i"))
    state = state.withColumn("g", root)
    out = []
    for k in reversed(range(len(levels))):
        step = 1 << k
        table_k = levels[k].select(F.col("p").alias("q"), F.col("r").alias("sub"))
        x = written(state.withColumn("q", _at("p", F.col("l"))).join(table_k, "q", "left").drop("q"), "lines-split")
        split = x.where("sub IS NOT NULL")
        groups = written(split.groupBy("g", "l", "sub").agg(F.min("p").alias("f"), F.count(F.lit(1)).alias("n")), "lines-intervals")
        y = written(split.join(groups, ["g", "l", "sub"]).select("p", "g", "l", "f", "n"), "lines-groups")
        out.append(y.where("n > 1 AND p <> f").select("p", (F.col("l") + step).alias("n")))
        down = y.where("n > 1").select("p", F.col("f").alias("g"), (F.col("l") + step).alias("l"))
        stay = x.where("sub IS NULL").select("p", "g", "l").union(y.where("p = f").select("p", "g", "l"))
        inner = stay.where("l > 0")
        many = written(inner.groupBy("g", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-many") if k else None
        if k:
            state = written(down.union(stay.where("l = 0")).union(inner.join(many, ["g", "l"], "left_semi").select("p", "g", "l")), "lines-state")
    return out


def without(text: str, runs: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str, int]:
    """text without the runs (first line, lines) of min_words words or more, and the number of lines deleted."""
    lines = text.split("\n")
    words = [0]
    for line in lines:
        words.append(words[-1] + len(line.split()))
    gone = [0] * (len(lines) + 1)
    for i, n in runs:
        if words[i + n] - words[i] >= min_words:
            gone[i] += 1
            gone[i + n] -= 1
    kept, depth = [], 0
    for line, g in zip(lines, gone):
        depth += g
        if not depth:
            kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (null as empty, later copies of repeated runs deleted), n_lines, n_deleted."""
    rows = written(id_text(docs).select((F.monotonically_increasing_id() + F.when(F.col("doc_id").isNull(), F.lit(_AFTER)).otherwise(0)).alias("u"), F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "doc_id", "text"), "lines-docs")
    with scratch(docs.sparkSession):
        levels = ranks(written(line_ids(rows), "lines"))
        found = seen_before(levels) if levels else []
        if found:
            runs = found[0]
            for x in found[1:]:
                runs = runs.union(x)
            own = runs.groupBy(F.col("p.u").alias("u")).agg(F.collect_list(F.struct(F.col("p.i").alias("i"), "n")).alias("runs"))  # of one document
            own = written(own, "lines-runs", keep=True)
    rows = rows.join(own, "u", "left") if found else rows.withColumn("runs", F.expr("CAST(NULL AS array<struct<i: int, n: int>>)"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            new, gone = without(text, [(r["i"], r["n"]) for r in own], min_words) if own else (text, 0)
            out.append((new, text.count("\n") + 1 if text else 0, gone))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64())))], ["doc_id", "text", "n_lines", "n_deleted"])

    return by_batch(rows.select("doc_id", "text", "runs"), run, "doc_id long, text string, n_lines long, n_deleted long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All later copies of repeated runs that have a word go, however short the run."""
    return line_dedup(table(spark, sf_dir, "documents"), 1)
