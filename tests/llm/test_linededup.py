import random

from larkspur.llm import linededup


def brute(docs, least):
    """docs: (doc_id, text) in the order of rows."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    lines = {k: docs[k][1].split("\n") if docs[k][1] else [] for k in order}
    places = [(k, i) for k in order for i in range(len(lines[k]))]
    runs = {k: [] for k in order}
    for b, (k, i) in enumerate(places):
        best = 0
        for k2, j in places[:b]:
            n = 0
            while i + n < len(lines[k]) and j + n < len(lines[k2]) and lines[k][i + n] == lines[k2][j + n]:
                n += 1
            best = max(best, n)
        if best:
            runs[k].append((i, best))
    return [(d, *(linededup.without(t, runs[k], least) if t else ("", 0))) for k, (d, t) in enumerate(docs)]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    docs = [(n, "\n".join(rnd.choice(["a", "b", "c d", "e"]) for _ in range(rnd.randint(0, 14)))) for n in range(14)]
    docs += [(100, docs[3][1] + "\n" + docs[5][1]), (101, None), (102, ""), (103, "\n".join(["z"] * 9)), (None, docs[3][1]), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = [(r["doc_id"], r["text"], r["n_deleted"]) for r in linededup.line_dedup(df, 3).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, 3), key=key)


def test_planted_passage(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(3))
    docs = [(1, f"one\n{passage}\ntwo"), (2, f"three\n{passage}"), (3, "four\nfive"), (4, "four\nsix")]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "three", 3: "four\nfive", 4: "four\nsix"}


def test_nasty_and_empty(nasty, nasty_rows, empty, documents):
    got = linededup.line_dedup(nasty).collect()
    assert len(got) == len(nasty_rows)
    assert sum(r["n_deleted"] for r in got if r["doc_id"] == 9) == 39
    assert linededup.line_dedup(empty).collect() == []
    none = documents.where("doc_id < 0")
    assert linededup.line_dedup(none).collect() == []


def test_query_deletes_short_later_copies(spark, tmp_path):
    docs = [(1, "one\n\nshort line\ntwo"), (2, "short line\nthree"), (3, "four\n\nshort line")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in linededup.op2(spark, str(tmp_path)).collect()}
    assert got == {1: docs[0][1], 2: "three", 3: "four"}


def test_null_ids_come_last(spark):
    """Even after the highest id, and whatever the order of the rows."""
    docs = [(None, "a b\nc d"), (2**63 - 1, "a b\nc d"), (None, "a b\nx")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.line_dedup(df, 1).collect()), key=repr)
    assert got == sorted([(2**63 - 1, docs[1][1]), (None, ""), (None, "x")], key=repr)
