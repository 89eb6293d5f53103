import random

import numpy as np

from larkspur.llm import quality
from larkspur.llm.rows import sifted


def test_grams():
    g = quality.Grams()
    assert list(g("")) == [] and len(g("abab")) == 2 + 2 + 2
    assert list(g("aa aa  aa b aa")) == list(quality.Grams()("\x01 \x01  aa b aa")) and list(g("a ab a")) == sorted(brute_grams("a ab a"))
    assert (g("xyz") == quality.Grams()("xyz")).all()


def brute_grams(text):
    """Places of the byte n-grams, by sets."""
    b = text.encode()
    at = set(b)
    at |= {256 + ((x << 8 | y) * 2654435761 % 2**32 >> 17) for x, y in zip(b, b[1:])}
    return at | {2**17 + ((x << 16 | y << 8 | z) * 2654435761 % 2**32 >> 15) for x, y, z in zip(b, b[1:], b[2:])}


def test_against_another_nb_svm(spark):
    """Counts by sets, the dual solved by projected gradients on the whole kernel: the same margins and predictions."""
    rnd = random.Random(6)
    word = lambda y: "".join(rnd.choice("abcde" if y else "defgh") for _ in range(rnd.randint(1, 5)))
    rows = [(i, " ".join(word(rnd.random() < (0.85 if i % 2 else 0.15)) for _ in range(rnd.randint(1, 12))), i % 2) for i in range(60)]
    model = quality.learn(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    grams = [sorted(brute_grams(" ".join(quality.SAME if a == b else a for a, b in zip(t.split(), [*t.split()[1:], None])))) for _, t, _ in rows]
    y = np.array([r[2] for r in rows])
    n = np.ones((2, 2**18))
    for g, k in zip(grams, y):
        n[k, g] += 1
    ratio = np.log((n[1] / (sum(y == 1) + 2)) / (n[0] / (sum(y == 0) + 2)))
    x = np.zeros((60, 2**18 + 1))
    for i, g in enumerate(grams):
        x[i, g], x[i, -1] = ratio[g] / np.sqrt(len(g)), 1
    fit = np.arange(60) % 4 != 0
    z = x[fit] * (2 * y[fit] - 1)[:, None]
    q = z @ z.T
    alpha, step = np.zeros(fit.sum()), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, quality.COST)
    margin = x @ (alpha @ z)
    got = np.array([model.margin(np.array(g)) for g in grams])
    assert np.abs(got - margin).max() < 0.02 and ((got > 0) == (margin > 0))[np.abs(margin) > 0.02].all()
    order = np.argsort(model.scores([r[1] for r in rows]))
    assert np.abs(np.sort(margin) - margin[order]).max() < 0.04


def test_ties_and_long_texts(spark):
    """Equal texts score alike and a score of exactly one half predicts 1; a small bound of the sample's bytes is kept to."""
    rows = [(i, "the same text", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q int")
    own = df.selectExpr("doc_id", "q AS quality")
    got = quality.scored(df.select("doc_id", "text"), own).collect()
    assert len({r["score"] for r in got}) == 1 and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = quality.SAMPLE_BYTES
    quality.SAMPLE_BYTES = 600
    try:
        assert len(quality.scored(df.select("doc_id", "text"), own).collect()) == 40
    finally:
        quality.SAMPLE_BYTES = held


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = np.sign(x @ [1, -2, 0.5] + 0.3 + rng.normal(size=40))
    w = quality.descend([(np.arange(3), v) for v in x], y, 3, epochs=2000)
    value = lambda w: (w @ w) / 2 + np.maximum(0, 1 - y * (x @ w[:3] + w[3])).sum()
    assert all(value(w) <= value(w + rng.normal(size=4) * s) + 1e-3 for s in (0.001, 0.01, 0.1) for _ in range(200))


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op3(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(got[i]["predicted"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_nasty(nasty, nasty_rows, labels, empty, spark):
    own = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored(nasty, own).count() == len(nasty_rows)
    one_class = quality.scored(nasty, own.where("quality = 1")).collect()
    assert len(one_class) == len(nasty_rows) and all(r["score"] > 0.5 for r in one_class)
    assert {r["score"] for r in quality.scored(nasty, own.where("false")).collect()} == {0.5}
    assert quality.scored(empty, labels).collect() == []


def test_sieve_loses_no_labelled_row(spark):
    docs = spark.range(-3000, 3000).selectExpr("id AS doc_id", "'x' AS text")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    kept = {r["doc_id"] for r in sifted(docs, ids).collect()}
    assert {i for i in range(-3000, 3000) if i % 7 == 0} <= kept and len(kept) < 900
