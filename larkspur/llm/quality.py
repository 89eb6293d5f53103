"""Quality classifier: naive Bayes support vectors.

Indicators of the byte 1- to 3-grams of a whole text, in which a word that the same word follows is written as one sign
(SAME), hashed to 2 ** BITS places, are scaled by the log ratio of their rates in the two classes. The rates are counted over all labelled rows; a linear hinge-loss model is then fitted by
dual coordinate descent on about SAMPLE rows of each class, chosen by a hash of their id, and a logistic curve, fitted
on the sampled rows that the model did not see, turns its margins to scores.

Defined results: null text counts as empty and has a score like any other (the bias alone); rows with null labels are
not learned from; of repeated rows each gets the same score; with labels of one class, or none, all scores are that
class's share or 0.5; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, crc_column, crc_text, id_text, scratch, table, written
from larkspur.llm.rows import sifted

BITS, SAMPLE, SMOOTH, COST, EPOCHS = 18, 1500, 1.0, 1.0, 20
SAMPLE_BYTES = 64 << 20  # of the sample's places; rows beyond it, by the hash of their ids, are left out of the sample
FOLDS, HELD = 3, 1
_SIZE = 1 << BITS
SAME = "\x01"
_again = re.compile(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")


class Grams:
    """The places of a text's n-grams, each once, ascending."""

    def __init__(self):
        self.flag = np.zeros(_SIZE, bool)

    def __call__(self, text: str) -> np.ndarray:
        b = np.frombuffer(_again.sub(SAME, text).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if not len(b):
            return np.zeros(0, np.int64)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        self.flag[b] = True
        self.flag[256 + (two * np.uint32(2654435761) >> np.uint32(32 - 15))] = True
        self.flag[_SIZE // 2 + (three * np.uint32(2654435761) >> np.uint32(32 - (BITS - 1)))] = True
        at = np.flatnonzero(self.flag)
        self.flag[at] = False
        return at


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights and, last, the bias: minimises |w|^2 / 2 + cost * sum of hinge losses over the rows x (places, values), y in {-1, 1}."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size + 1), np.zeros(len(x))
    norm = np.array([v @ v + 1 for _, v in x])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by damped Newton steps; a is not negative."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([d @ margin + 1e-2 * (a - 1), d.sum()])
        h = np.array([[s @ margin**2 + 1e-2, s @ margin], [s @ margin, s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 0.0), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    def __init__(self, weights: np.ndarray, a: float, b: float):
        self.weights, self.a, self.b, self.grams = weights, a, b, None

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(len(at)) + self.weights[-1]) if len(at) else float(self.weights[-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        self.grams = self.grams or Grams()
        m = np.array([self.margin(self.grams(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, y (0 or 1)."""
    totals = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        share = min(max(float(next(iter(totals), 0.5)), 0.01), 0.99)
        return Model(np.zeros(_SIZE + 1), 1.0, float(np.log(share / (1 - share))))

    def count(batch: pa.RecordBatch, grams: Grams) -> pa.RecordBatch:
        n = np.zeros((2, _SIZE), np.int64)
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            n[y, grams(text)] += 1
        y, at = np.nonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(y), pa.array(at), pa.array(n[y, at])], ["y", "place", "n"])

    # At most two classes times 2 ** BITS rows, whatever the input.
    counted = by_batch(labelled.select("text", "y"), count, "y long, place long, n long", Grams).groupBy("place").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]).toPandas()
    n = np.full((2, _SIZE), SMOOTH)
    for y in (0, 1):
        n[y, counted["place"]] += counted[f"n{y}"]
    rate = n / (np.array([totals[0], totals[1]])[:, None] + 2 * SMOOTH)
    ratio = np.log(rate[1] / rate[0])

    chance = F.when(F.col("y") == 0, min(1.0, sample / totals[0])).otherwise(min(1.0, sample / totals[1]))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < chance * 1_000_000)

    def places(batch: pa.RecordBatch, grams: Grams) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([grams(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "y", "places"])

    # About 2 * sample rows; of SAMPLE_BYTES at most, as a hash thins them out where texts are very long.
    held = written(by_batch(chosen.select("doc_id", "text", "y"), places, "doc_id long, y int, places binary", Grams), "quality-sample")
    size = held.agg(F.sum(F.length("places"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        held = held.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < int(900_000 * SAMPLE_BYTES / size))
    rows = held.collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["places"]))
    at = [np.frombuffer(r["places"], "<i4") for r in rows]
    x = [(p, ratio[p] / np.sqrt(max(len(p), 1))) for p in at]
    y = np.array([r["y"] for r in rows])
    fit = np.arange(len(rows)) % 4 != 0
    w = descend([v for v, f in zip(x, fit) if f], 2 * y[fit] - 1, _SIZE)
    weights = np.append(w[:-1] * ratio, w[-1])
    seen = Model(weights, 1.0, 0.0)
    rest = ~fit if len(set(y[~fit])) == 2 else np.ones(len(y), bool)
    margin = np.array([seen.margin(p) for p, r in zip(at, rest) if r])
    # Both classes are sampled alike; the weights bring back their shares.
    a, b = logistic(margin, y[rest])
    kept = {k: min(1.0, sample / totals[k]) for k in (0, 1)}
    return Model(weights, a, b - float(np.log(kept[1] / kept[0])))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y of the documents that have a label and are not held out. Null ids are never labelled."""
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y")).where(crc_column() % FOLDS != HELD)
    # A merge join whatever the size, as labels grow with documents; the text of documents without a label stays out of it.
    return sifted(id_text(docs), own).join(own.hint("merge"), "doc_id")


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    with scratch(docs.sparkSession):
        model = docs.sparkSession.sparkContext.broadcast(learn(written(labelled_rows(docs, labels), "quality-labelled"), sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.value.scores(batch.column("text").to_pylist())
        held = [crc_text(x) % FOLDS == HELD for x in batch.column("doc_id").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return by_batch(id_text(docs), run, "doc_id long, held_out boolean, score double, predicted int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
