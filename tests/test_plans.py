import numpy as np
import pytest

from larkspur.operators import matrix
from larkspur.plans import als, credit, reasons, recommend, walk

M = [[5, 5, 2, None], [2, None, 3, 5], [None, 5, None, 3], [3, None, None, 5]]


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame([(u, i, float(x)) for u, row in enumerate(M) for i, x in enumerate(row) if x], "user long, item long, rating double")


@pytest.mark.parametrize("strategy", ["broadcast", "join"])
def test_explicit(rated, strategy):
    users, items, _ = als.factorise(rated, 3, 5, 0.065, strategy=strategy)
    assert als.rmse(rated, users, items) < 0.2


def test_implicit(spark, rated):
    users, items, moved = als.factorise(rated, 3, 5, 0.065, implicit=True, alpha=20, curve=True)
    full = spark.createDataFrame([(u, i, float(x or 0)) for u, row in enumerate(M) for i, x in enumerate(row)], "user long, item long, rating double")
    assert als.rmse(full, users, items, implicit=True, alpha=20) < 0.4
    assert len(moved) == 5 and moved[-1][2] < moved[1][2]


def test_half_step_against_numpy(spark, rated):
    rng = np.random.default_rng(1)
    y = rng.random((4, 3))
    items = spark.createDataFrame([(i, y[i].tolist()) for i in range(4)], "id long, f array<double>")
    got = {r["id"]: np.array(r["f"]) for r in als.half_step(rated, items, "user", "item", 3, 0.1, 20.0, implicit=True).collect()}
    for u, row in enumerate(M):
        c = np.diag([20.0 * (x or 0) for x in row])
        p = np.array([1.0 if x else 0 for x in row])
        want = np.linalg.solve(y.T @ y + y.T @ c @ y + 0.1 * np.eye(3), y.T @ (np.eye(4) + c) @ p)
        assert np.allclose(got[u], want)


def test_recommend(spark, rated):
    rng = np.random.default_rng(2)
    u, v = rng.random((4, 3)), rng.random((9, 3))
    side = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, f array<double>")
    got = {(r["user"], r["rank"]): r["item"] for r in recommend.score_topk(side(u), side(v), 4, block=2).collect()}
    for i, s in enumerate(u @ v.T):
        assert [got[i, k] for k in range(1, 5)] == list(np.argsort(-s)[:4])
    fresh = recommend.recommend(side(u), side(v), rated, 3)
    assert fresh.join(rated, ["user", "item"]).count() == 0
    assert fresh.groupBy("user").count().where("count = 3").count() == 4


def test_walk_against_numpy(spark):
    a = np.array([[1.0, 2, 0], [0, 1, 3]])
    edges = matrix.from_dense(spark, a).selectExpr("row AS user", "col AS item", "value AS weight")
    v, w = a / a.sum(1, keepdims=True), (a / a.sum(0)).T
    users, items = walk.random_walk(edges, 2)
    assert np.allclose(matrix.dense(users, 2, 3), v @ (w @ v)) and np.allclose(matrix.dense(items, 3, 3), w @ v @ w @ v)
    legacy, _ = walk.random_walk(edges, 2, legacy_orientation=True)
    assert np.allclose(matrix.dense(legacy, 2, 3), v @ (w @ v).T)
    best, inverse = walk.walk_lists(edges, users, items, 1)
    assert best.count() == 2 and inverse.count() == 3


def test_credit_against_numpy(spark):
    a = np.array([[1.0, 2, 0], [0, 1, 3]])
    m = np.array([1.0, 1.5, 3])
    got = {r["row"]: r["distance"] for r in credit.user_credit(matrix.from_dense(spark, a)).collect()}
    for i in range(2):
        assert abs(got[i] - (1 - a[i] @ m / np.linalg.norm(a[i]) / np.linalg.norm(m))) < 1e-12


def test_reasons(spark):
    recs = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0), (1, 12, 1.0)], "user long, item long, score double")
    rated = spark.createDataFrame([(1, 1), (1, 2)], "user long, item long")
    similar = spark.createDataFrame([(10, 2, 0.5)], "item long, other long, similarity double")
    meta = spark.createDataFrame([(10, "zz"), (11, "ab"), (1, "x"), (2, "abc"), (12, "q")], "item long, category string")
    got = {r["item"]: (r["reason"], r["kind"]) for r in reasons.reasons(recs, rated, similar, meta, 1.5).collect()}
    assert got == {10: (2, "SIMILARITY"), 11: (2, "CATEGORY"), 12: (1, "RANDOM")}


def test_als_reasons(spark, rated):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(4, 3))
    items = spark.createDataFrame([(i, y[i].tolist()) for i in range(4)], "id long, f array<double>")
    recs = spark.createDataFrame([(0, 3)], "user long, item long")
    got = reasons.als_reasons(recs, rated, items, y.T @ y, 0.1, 20.0).first()
    c = np.diag([20.0 * (x or 0) for x in M[0]])
    s = y[:3] @ np.linalg.solve(y.T @ y + y.T @ c @ y + 0.1 * np.eye(3), y[3])
    assert got["reason"] == (int(s.argmax()) if s.max() > 0 else -1)


def test_als_reasons_compares_rounded_values(spark):
    """Against a large Y'Y values lie close together: of those that are equal at 12 decimals the lowest id wins, and zero at 12 decimals is no reason."""
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1 + 1e-7, 0.0]), (3, [1e-7, 0.0]), (9, [1.0, 0.0])], "id long, f array<double>")
    own = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (5, 3, 1.0)], "user long, item long, rating double")
    recs = spark.createDataFrame([(0, 9), (5, 9)], "user long, item long")
    got = reasons.als_reasons(recs, own, items, 2e6 * np.eye(2), 0.1, 1.5)
    assert {r["user"]: r["reason"] for r in got.collect()} == {0: 1, 5: -1}


def test_association_similarity(spark):
    rules = spark.createDataFrame([("a", "b", 0.5), ("a", "q", 0.1)], "item string, other string, similarity double")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "id long, value string")
    assert [tuple(r) for r in reasons.association_similarity(rules, names).collect()] == [(0, 1, 0.5)]


@pytest.mark.parametrize("implicit", [False, True])
def test_hot_rows_in_several_tasks(rated, monkeypatch, implicit):
    """Rows dealt to several tasks give the same factors as whole ones; also with more features than ratings of a row."""
    rng = np.random.default_rng(4)
    y = rng.random((4, 6))
    items = rated.sparkSession.createDataFrame([(i, y[i].tolist()) for i in range(4)], "id long, f array<double>")
    step = lambda strategy: {r["id"]: r["f"] for r in als.half_step(rated, items, "user", "item", 6, 0.1, 20.0, implicit, strategy).collect()}
    whole = step("broadcast")
    monkeypatch.setattr(als, "HOT", 2)
    for strategy in ("broadcast", "join"):
        split = step(strategy)
        assert set(split) == set(whole) == {0, 1, 2, 3} and all(np.allclose(split[u], whole[u]) for u in whole)
    assert als.dealt(rated, "user", "item")[1]


def test_gram(spark):
    y = np.random.default_rng(5).random((37, 5))
    f = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(y)], "id long, f array<double>")
    assert np.allclose(als.gram(f, 5), y.T @ y) and (als.gram(f.where("false"), 5) == 0).all()


def test_goes_on_after_the_last_whole_iteration(rated, tmp_path):
    folder = f"{tmp_path}/als"
    users, items, _ = als.factorise(rated, 3, 4, 0.065)
    als.factorise(rated, 3, 2, 0.065, folder=folder)
    assert als.finished(rated.sparkSession, folder) == [1]
    (tmp_path / "als" / "iteration-2" / "users").mkdir(parents=True)  # broken off
    again, _, moved = als.factorise(rated, 3, 4, 0.065, folder=folder, curve=True)
    assert [m[0] for m in moved] == [2, 3] and als.finished(rated.sparkSession, folder) == [3]
    want = {r["id"]: r["f"] for r in users.collect()}
    assert all(np.allclose(r["f"], want[r["id"]]) for r in again.collect())


def test_selection_against_a_full_sort():
    rng = np.random.default_rng(6)
    for _ in range(20):
        s = rng.integers(0, 6, (150, 40)).astype(float)  # many ties
        take = rng.integers(0, 60, 150)
        r, c = recommend._best(s, take)
        for i in range(150):
            assert c[r == i].tolist() == np.argsort(-s[i], kind="stable")[: take[i]].tolist()


def test_scores_with_ties_in_many_blocks_and_bundles(spark):
    rng = np.random.default_rng(7)
    u, v = rng.integers(-3, 4, (30, 2)).astype(float), rng.integers(-3, 4, (50, 2)).astype(float)
    side = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, f array<double>")
    extra = spark.createDataFrame([(i, i % 5) for i in range(0, 30, 2)], "user long, n long")
    got = {}
    for r in recommend.score_topk(side(u), side(v), 3, extra, block=7, group=4).collect():
        got.setdefault(r["user"], {})[r["rank"]] = r["item"]
    for i, s in enumerate(u @ v.T):
        n = 3 + (i % 5 if i % 2 == 0 else 0)
        assert [got[i][k] for k in range(1, n + 1)] == np.argsort(-s, kind="stable")[:n].tolist() and len(got[i]) == n


@pytest.mark.parametrize("small", [True, False])
def test_lists_by_broadcast_and_by_dealt_blocks(spark, monkeypatch, small):
    """Both ways give what a full sort gives, ties and rated items included, and no more than k rows a user leave the scoring."""
    monkeypatch.setattr(recommend, "BROADCAST_BYTES", recommend.BROADCAST_BYTES if small else 0)
    rng = np.random.default_rng(8)
    u, v = rng.integers(-3, 4, (40, 3)).astype(float), rng.integers(-3, 4, (90, 3)).astype(float)
    u[3] = 0
    side = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, f array<double>")
    seen = {(int(a), int(b)) for a, b in zip(rng.integers(0, 35, 300), rng.integers(0, 90, 300))}
    rated = spark.createDataFrame([(a, b) for a, b in [*seen, *list(seen)[:9]]], "user long, item long")
    out = recommend.recommend(side(u), side(v), rated, 4, 0.97, block=8, group=7)
    got = {}
    for r in out.collect():
        got.setdefault(r["user"], []).append((r["rank"], r["item"], round(r["score"], 9)))
    for a, s in enumerate(u @ v.T):
        top = np.argsort(-s, kind="stable")[: 4 + sum(x == a for x, _ in seen)]
        low, high = s[top].min(), s[top].max()
        of = {int(i): min(0.97, s[i] if low == high else (s[i] - low) / (high - low) * 0.5 + 0.5) for i in top if (a, int(i)) not in seen}
        want = sorted(of, key=lambda i: (-of[i], i))[:4]
        assert sorted(got.get(a, [])) == [(n + 1, i, round(of[i], 9)) for n, i in enumerate(want)]
    # What goes through an exchange: users, item blocks and ratings, but no scores.
    assert "Window" not in out._jdf.queryExecution().toString() and "score" not in str(out._jdf.queryExecution().optimizedPlan().children().head().output())
