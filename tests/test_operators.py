import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.vectors import DISTANCES, common_prefix, prefix_ratio
from larkspur.operators import evaluate, indexing, matrix, minhash, patterns, relational, splits, topk
from larkspur.operators.joins import Target, cogroup, equi_join, lookup_join

SOURCE = [("A", f"I{i}", i / 10, i % 2, 5) for i in range(1, 6)] + [("B", f"I{i}", i / 10, 0, 4) for i in range(1, 5)] + [("C", f"I{i}", i / 10, 1, 4) for i in (1, 2, 6, 7)]
TARGET = [("A", "I1"), ("B", "I3"), ("B", "I4"), ("A", "I2"), ("C", "I2")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(SOURCE, "user string, item string, score double, flag int, item_count int"), spark.createDataFrame(TARGET, "u string, i string")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind, count", [("inner", 5), ("outer", 13), ("filter", 8)])
def test_lookup(sides, small, kind, count):
    s, t = sides
    got = lookup_join(s, ["user", "item"], [Target(t, ["u", "i"], ["u"], kind)], small=small).collect()
    assert len(got) == count
    if kind == "outer":
        assert sum(r["u"] == "null" for r in got) == 8


def test_lookup_never_multiplies_and_nulls_do_not_match(spark):
    s = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    t = spark.createDataFrame([("a", 2), ("a", 1), (None, 9)], "k string, v int")
    assert rows(lookup_join(s, ["k"], [Target(t, ["k"], ["v"], "outer")], default=0)) == sorted([("a", 1), ("b", 0), (None, 0)], key=repr)
    assert rows(lookup_join(s, ["k"], [Target(t, ["k"], ["v"], "sub", ["k"])])) == [(1,)]
    assert rows(lookup_join(s, ["k"], [Target(t.where("false"), ["k"], ["v"], "filter")])) == rows(s)


def test_lookup_unknown_kind(sides):
    with pytest.raises(ValueError):
        lookup_join(sides[0], ["user"], [Target(sides[1], ["u"], ["i"], "range")])


def test_equi_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k int, w int")
    assert rows(equi_join(a, b, ["k"], ["v"], ["w"])) == [(1, "x", 5), (1, "x", 6)]
    assert rows(equi_join(a, b, ["k"], ["v"], ["w"], "left")) == [(1, "x", 5), (1, "x", 6), (2, "y", 0)]
    assert rows(equi_join(a, b, ["k"], ["v"], ["w"], "minus")) == [(2, "y")]


def test_cogroup(spark):
    v = spark.createDataFrame([(1, "v1"), (2, "v2"), (2, "v2")], "k int, v string")
    p = spark.createDataFrame([(1, 9, 1.0), (1, 3, 2.0), (7, 1, 1.0)], "k int, i int, x double")
    assert rows(cogroup(v, p, "k", "v", "i", "x")) == [(1, "v1", True, [3, 9], [2.0, 1.0]), (2, "v2", False, [], [])]


def test_select_and_log(spark):
    df = spark.createDataFrame([("a", "1.5", "z")], "c0 string, c1 string, c2 string")
    assert relational.select_columns(df, [2, 0, 0, 5, 1], 1).collect()[0] == ("z", "a", "a", math.log(2.5) + 1)
    assert relational.log_last(df.select("c0", "c1")).first()[1] == math.log(2.5) + 1


def test_filter_input(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "R1"), (2, "a"), (2, "bad"), (3, "H")], "u int, i string")
    assert rows(relational.filter_input(df, "u", "i", spark.createDataFrame([("bad",)], "x string"), least=2)) == [(1, "a"), (1, "b")]


def test_distinct_columns(spark):
    df = spark.createDataFrame([("A", 1, 0.3, 30, "XY"), ("B", 2, 0.6, 23, "Z")], "c0 string, c1 int, c2 double, c3 int, c4 string")
    assert rows(relational.distinct_columns(df, [0, 1, 5])) == [("c0", "A"), ("c0", "B"), ("c1", "1"), ("c1", "2")]


def test_sums_and_means(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0), (1, 3, 4.0), (2, 1, 0.0)], "row int, col int, value double")
    assert rows(relational.row_average(df)) == [(1, 3.0)]
    assert rows(relational.item_counts(df)) == [(1, 2)]
    assert relational.column_sums(df, ["value"]).first() == (4, 6.0)
    assert relational.column_sums(df, ["row", "col"], exclude=True).first() == (4, 6.0)
    assert relational.prune(df, 2.0).count() == 2


def test_jaccard(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (3, "q")], "k int, v string")
    assert rows(relational.jaccard([a, b], "k", "v")) == [(1, 2, 2, 1.0)]
    assert rows(relational.jaccard([a, b], "k", "v", strict=True)) == [(1, 1, 2, 0.5)]
    assert relational.jaccard_stats(relational.jaccard([a, b], "k", "v")).first() == (1, 1.0)


@pytest.mark.parametrize("start", [0, 1, 100, 923])
def test_sequential_ids(spark, start):
    df = spark.createDataFrame([(str(1000 + i),) for i in range(10)], "value string").repartition(3)
    assert rows(indexing.sequential_ids(df, ["value"], start)) == sorted(((start + i, str(1000 + i)) for i in range(10)), key=repr)


def test_sequential_ids_empty(spark):
    assert indexing.sequential_ids(spark.createDataFrame([], "v string"), ["v"]).collect() == []


def test_dictionary(spark):
    df = spark.createDataFrame([(c, c.upper()) for c in "jihgfedcba"], "x string, y string")
    own = {c: indexing.dictionary(df, c) for c in ("x", "y")}
    assert rows(indexing.encode(df, own)) == sorted(((i, i) for i in range(10)), key=repr)
    assert rows(indexing.dictionary_sizes(own)) == [("x", 10), ("y", 10)]
    assert rows(indexing.decode(indexing.encode(df, own), own)) == rows(df)
    grown = indexing.dictionary(spark.createDataFrame([("0",), ("a",), ("k",)], "x string"), "x", own["x"])
    assert [r for r in rows(grown) if r[0] > 9] == [(10, "0"), (11, "k")]


def test_matrix_from_table(spark):
    df = spark.createDataFrame([("2", "3", "4.3"), ("x", "1", "1"), ("1", "1", None), ("2", "3", "1")], "r string, c string, v string")
    assert rows(matrix.from_table(df, "r", "c", "v")) == [(2, 3, 5.3)]
    assert rows(matrix.from_table(df.limit(1), "c", "r")) == [(3, 2, 1.0)]


def test_vector_merge_and_compact(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0)], "row int, col int, value double")
    packed = matrix.compact(matrix.vector_merge(df))
    assert packed.first()["cells"] == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}
    assert rows(matrix.spread(packed)) == rows(df)


def test_products_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (7, 5)).astype(float), rng.integers(0, 3, (5, 6)).astype(float)
    da, db = matrix.from_dense(spark, a), matrix.from_dense(spark, b)
    for strategy, block in ((None, 2), (None, 256), (4, 256)):
        assert np.allclose(matrix.dense(matrix.multiply(da, db, strategy=strategy, block=block), 7, 6), a @ b)
    assert np.allclose(matrix.dense(matrix.gram(da), 5, 5), a.T @ a)
    assert np.allclose(matrix.dense(matrix.atb(da, da, 4.0), 5, 5), np.where(a.T @ a >= 4, a.T @ a, 0))
    with pytest.raises(ValueError):
        matrix.dense(da, 10**6, 10**6)


def test_norms_and_distance(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 1, 1.0), (2, 2, -1.0)], "row int, col int, value double")
    assert [r for r in rows(matrix.l1_normalise(df)) if r[0] == 1] == [(1, 1, 3 / 7), (1, 2, 4 / 7)]
    assert all(r[2] is None for r in rows(matrix.l1_normalise(df)) if r[0] == 2)
    assert [r for r in rows(matrix.l2_normalise(df)) if r[0] == 1] == [(1, 1, 0.6), (1, 2, 0.8)]
    assert rows(matrix.distance_squared(df, df.where("col = 1"))) == [(1, 16.0), (2, 1.0)]


def test_matrix_text(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 1, 4.0)], "row int, col int, value double")
    assert matrix.to_text(df).first()[0] == "1\t\t1:4.0\t2:3.0"
    assert rows(matrix.to_text(df, "raw")) == [("1,1,4.0",), ("1,2,3.0",)]


def test_distances(spark):
    x, y = np.array([1.0, 2, 3]), np.array([2.0, 0, 1])
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    got = df.select(*[f(F.col("x"), F.col("y")).alias(n) for n, f in DISTANCES.items()]).first()
    cos = 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    want = {"cosine": cos, "euclidean": np.linalg.norm(x - y), "squared_euclidean": ((x - y) ** 2).sum(), "manhattan": abs(x - y).sum(), "tanimoto": 1 - x @ y / (x @ x + y @ y - x @ y)}
    assert all(abs(got[n] - v) < 1e-12 for n, v in want.items())


def test_prefix(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("ab", "ab"), ("", "a"), ("x", ""), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, 0, None]
    assert df.select(prefix_ratio(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_topk(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 4, 2.0), (1, 3, 9.0), (2, 1, 1.0)], "row int, col int, value double")
    assert rows(topk.topk_rows(df, 2)) == [(1, 3, 9.0, 1), (1, 4, 2.0, 2), (2, 1, 1.0, 1)]
    assert rows(topk.wide_text(topk.topk_wide(df, 2), "row", "col", "value")) == [(1, "3,9.0,4,2.0"), (2, "1,1.0")]
    assert sorted(r["value"] for r in topk.minmax_scores(df, 0.9).collect()) == [0.5, 0.5, 0.9, 0.9]


def test_splits(spark):
    df = spark.createDataFrame([(u, i) for u in range(20) for i in range(10)], "u int, i int")
    train, probe = splits.random_split(df, 0.6, 0.2)
    assert 80 < train.count() < 160 and 10 < probe.count() < 80 and train.join(probe, ["u", "i"]).count() == 0
    folded = splits.kfold(df, "u", 4)
    assert [r["n"] for r in folded.where("u = 3").groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()] == [3, 3, 3, 1]
    parts = [splits.fold(folded, i) for i in range(4)]
    assert all(a.count() + b.count() == 200 for a, b in parts) and sum(b.count() for _, b in parts) == 200


def test_kfold_of_a_hot_user(spark):
    made = [(7, i % 50) for i in range(300)] + [(None, i) for i in range(9)] + [(u, 0) for u in range(100, 140)]
    df = spark.createDataFrame(made, "u int, i int").repartition(8)
    got = [tuple(r) for r in splits.kfold(df, "u", 4, F.col("i").desc()).collect()]
    assert sorted((u or -1, i) for u, i, _ in got) == sorted((u or -1, i) for u, i in made)
    for user in (7, None, 120):
        own = sorted((f, -i) for u, i, f in got if u == user)
        width = -(-len(own) // 4)
        assert [-i for _, i in own] == sorted((i for u, i in made if u == user), reverse=True)
        assert [f for f, _ in own] == [p // width for p in range(len(own))]
    assert splits.kfold(df.where("false"), "u").collect() == []


def test_minmax_scores_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), (1, 1, 3.0), (1, 2, None)], "row int, col int, value double")
    assert rows(topk.minmax_scores(df)) == sorted([(None, 1, 0.5), (None, 2, 1.0), (1, 1, 3.0), (1, 2, None)], key=repr)


def test_evaluate(spark):
    recs = spark.createDataFrame([(1, i, 10.0 - i, 4, 3.0 if i in (1, 3) else -1.0) for i in range(1, 6)], "user int, item int, score double, item_count int, flag double")
    got = evaluate.evaluate(recs, 4).first()
    assert (got["hits"], got["precision"], got["map"]) == (2, 0.5, (1 + 2 / 3) / 4)
    weights, percents = [3, -1, 3, -1], [0, 20, 40, 100]
    assert abs(got["epr"] - sum(w * p for w, p in zip(weights, percents)) / 4) < 1e-9
    assert [got[f"recall_{i}"] for i in range(1, 5)] == [0.25, 0.25, 0.5, 0.5]
    assert evaluate.stats(evaluate.evaluate(recs, 4)).first()["n_users"] == 1
    lists = evaluate.ranked_lists(recs, 3).collect()
    assert sorted((r["rank"], r["n"], r["so_far"]) for r in lists) == [(1, 5, 1), (2, 5, 1), (3, 5, 2)]


def test_minhash(spark):
    sets = spark.createDataFrame([(i, e) for i, s in enumerate([range(20), range(20), range(50, 70)]) for e in s], "id int, e int")
    for kind in ("linear", "murmur", "xx"):
        got = minhash.minhash_clusters(sets, "id", "e", min_cluster=2, kind=kind).collect()
        assert {r["id"] for r in got} == {0, 1}
    assert minhash.minhash_clusters(sets, "id", "e", min_set=21).count() == 0
    assert "elements" in minhash.minhash_clusters(sets, "id", "e", debug=True).columns


def test_patterns(spark):
    baskets = patterns.transactions(spark.createDataFrame([("a, b,c",), ("a|b",), ("a\tb,b",), ("c",), ("",)], "value string"))
    assert [tuple(r) for r in patterns.frequent_items(baskets, 2).collect()] == [("a", 3), ("b", 3), ("c", 2)]
    got = rows(patterns.top_patterns(baskets, 3, 2))
    assert got == [("a", ["a", "b"], 3, 1), ("a", ["a"], 3, 2), ("b", ["a", "b"], 3, 1), ("b", ["b"], 3, 2)]
    assert patterns.top_patterns(baskets.where("false"), 3, 2).collect() == []


def test_broadcast_only_if_small(spark, sf):
    from larkspur.session import broadcast_if_small

    df = spark.read.parquet(f"{sf}/customer.parquet")
    hinted = lambda most: "broadcast" in broadcast_if_small(df, most)._jdf.queryExecution().logical().toString().lower()
    assert hinted(1 << 30) and not hinted(10)


def test_patterns_of_all_sizes(spark):
    """Against counting every subset of every basket."""
    import itertools
    import random
    from collections import Counter

    from larkspur.operators import patterns

    rnd = random.Random(3)
    baskets = [sorted(rnd.sample("abcdefg", rnd.randint(0, 6))) for _ in range(60)]
    got = {}
    for r in patterns.top_patterns(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), 4, 9).collect():
        got.setdefault(r["item"], {})[r["rank"]] = (r["n"], tuple(r["pattern"]))
    n = Counter(c for b in baskets for k in range(1, 7) for c in itertools.combinations(b, k))
    for x in "abcdefg":
        want = sorted(((-m, -len(c), ",".join(c), c) for c, m in n.items() if m >= 4 and x in c))[:9]
        assert [got[x][k] for k in sorted(got[x])] == [(-m, c) for m, _, _, c in want] and any(len(c) > 2 for *_, c in want)


def test_uniform_numbers(spark):
    from larkspur.operators.splits import uniform

    u = [r[0] for r in spark.range(20_000).select(uniform("id", kind="arithmetic")).collect()]
    assert all(0 <= x < 1 for x in u) and len(set(u)) > 19_900
    counts = [sum(k / 10 <= x < (k + 1) / 10 for x in u) for k in range(10)]
    assert min(counts) > 1800 and max(counts) < 2200
    assert abs(sum((x - 0.5) * (y - 0.5) for x, y in zip(u, u[1:])) / len(u)) < 0.002


@pytest.mark.parametrize("once", [4_000_000, 7])
def test_products_by_blocks_of_columns(spark, monkeypatch, once):
    """Every cell, in pieces too, for one matrix and for two, with hot rows and columns; no pair of cells goes through an exchange."""
    monkeypatch.setattr(matrix, "AT_ONCE", once)
    monkeypatch.setattr(matrix, "BLOCK_CELLS", 40)
    rng = np.random.default_rng(9)
    a, b = rng.integers(-2, 3, (40, 23)) * (rng.random((40, 23)) < 0.3), rng.integers(-2, 3, (40, 31)) * (rng.random((40, 31)) < 0.3)
    a[:, 4], a[7] = 1, 2
    da, db = (matrix.from_dense(spark, x.astype(float)) for x in (a, b))
    for got, want in ((matrix.gram(da), a.T @ a), (matrix.atb(da, db), a.T @ b)):
        rows = got.collect()
        assert {(r["row"], r["col"]): r["value"] for r in rows} == {(int(i), int(j)): want[i, j] for i, j in zip(*np.nonzero(want))} and len(rows) == np.count_nonzero(want)
        assert "Join" not in got._jdf.queryExecution().toString() and "Aggregate" not in got._jdf.queryExecution().toString()
    assert {(r["row"], r["col"]) for r in matrix.atb(da, db, 3).collect()} == {(int(i), int(j)) for i, j in np.argwhere(a.T @ b >= 3)}
