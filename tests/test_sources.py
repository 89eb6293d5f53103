from functools import partial

from pyspark.sql import functions as F

from larkspur.operators import matrix
from larkspur.sources import delimited, sinks


def test_index_list():
    assert [delimited.index_list(x) for x in ("1,2,3", ",,,1,2,3,", "1,,2,3,,,", "1,a,2, 3 ,-,x4")] == [[1, 2, 3]] * 4


def test_encode_fields(spark):
    lines = spark.createDataFrame([("343,12,,434,343",), ("x,324,231,23,123",), ("x,",)], "value string")
    own = delimited.comma_fields(F.col("value"))
    assert [r[0] for r in lines.select(delimited.encode_fields(own, [0, 2, 1])).collect()] == ["343,,12", "x,231,324", "x"]
    assert lines.select(delimited.fetch_fields(own, [0, 9, 1])).first()[0] == "343,,12"
    assert lines.select(F.size(own)).collect()[2][0] == 1


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.5), (2, 3, 4.5)], "user long, item long, rating double")
    sinks.write_text(df, f"{tmp_path}/t")
    spark.createDataFrame([("bad,1,x",), ("7",)], "value string").write.mode("append").text(f"{tmp_path}/t")
    got = delimited.read_columns(spark, f"{tmp_path}/t", {"user": "long", "item": "long", "rating": "double"})
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3.5), (2, 3, 4.5)]
    assert delimited.read_lines(spark, f"{tmp_path}/t", f"{tmp_path}/t", tag="t").groupBy("t").count().count() == 2
    assert {tuple(r) for r in delimited.side_table(spark, f"{tmp_path}/t", [0], [2]).collect()} == {("1", "3.5"), ("2", "4.5"), ("bad", "x"), ("7", "")}


def test_sorted_lookup(spark, tmp_path):
    sinks.write_sorted(spark.range(1000), "id", f"{tmp_path}/s", 4)
    found = sinks.lookup(spark, f"{tmp_path}/s", "id", [5, 700, 2000])
    assert sorted(r["id"] for r in found.collect()) == [5, 700]
    assert "PushedFilters: [In(id" in found._jdf.queryExecution().toString()


def test_by_value_and_store(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 3, 4.0), (2, 1, 1.0)], "row long, col long, value double")
    sinks.write_by_value(cells, "row", f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v/row=1").count() == 2
    sinks.write_rows(cells, partial(sinks.FileStore, f"{tmp_path}/kv"))
    asked = spark.createDataFrame([(1,), (2,), (9,)], "k long")
    got = sinks.fetch_rows(asked, "k", partial(sinks.FileStore, f"{tmp_path}/kv"), ["vector:0", "vector:3"], go=2)
    assert sorted(map(tuple, got.collect())) == [(1, "2.0", "4.0"), (2, None, None), (9, None, None)]
    assert sinks.fetch_rows(asked.where("false"), "k", partial(sinks.FileStore, f"{tmp_path}/kv"), ["x"]).collect() == []
    lines = sorted(x for f in (tmp_path / "kv").iterdir() for x in f.read_text().splitlines())
    assert lines == ["1\tvector:0\t2.0", "1\tvector:3\t4.0", "2\tvector:1\t1.0"]


def test_dense_round_trip(spark):
    import numpy as np

    m = np.random.default_rng(0).random((3, 3))
    assert np.allclose(matrix.dense(matrix.from_dense(spark, m), 3, 3), m, atol=1e-6)


def test_targets_from_text(spark, tmp_path):
    from larkspur.operators.joins import lookup_join
    from larkspur.sources.options import read_places, targets

    for name, lines in (("s", ["A,I1,0.1", "B,I2,0.2", "C,I9"]), ("t", ["A,I1,x", "B,I2"]), ("names", ["A,Anna", "B,Bert", "C,Carl"])):
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/{name}")
    own = targets(spark, f"{tmp_path}/t::0,1:2:outer::{tmp_path}/names:0:0:1:sub")
    assert [t.kind for t in own] == ["outer", "sub"]
    source = read_places(spark, f"{tmp_path}/s", 3)
    joined = lookup_join(source, ["c0", "c1"], own[:1])
    got = lookup_join(joined, ["c0"], own[1:])
    assert sorted(map(tuple, got.collect())) == [("Anna", "I1", "0.1", "x"), ("Bert", "I2", "0.2", ""), ("Carl", "I9", "", "null")]


def test_random_cells(spark):
    a, b = (matrix.random_cells(spark, 10, 10).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) == 100 and all(0 <= r["value"] < 1 for r in a)


def test_files(spark, tmp_path):
    import pytest

    sinks.write_string(spark, f"{tmp_path}/stats", "n 3\nmean 0.5")
    sinks.write_string(spark, f"{tmp_path}/stats", "n 4")
    assert sinks.read_string(spark, f"{tmp_path}/stats") == "n 4"
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/t")
    sinks.move(spark, f"{tmp_path}/t", f"{tmp_path}/u")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 10 and not (tmp_path / "t").exists()
    with pytest.raises(OSError):
        sinks.move(spark, f"{tmp_path}/t", f"{tmp_path}/v")
    sinks.compact_sorted(spark, f"{tmp_path}/u", "id", f"{tmp_path}/w", 2)
    assert not (tmp_path / "u").exists() and sorted(r["id"] for r in sinks.lookup(spark, f"{tmp_path}/w", "id", [3, 4, 99]).collect()) == [3, 4]
    assert sinks.delete_parts(spark, f"{tmp_path}/w") == 2 and (tmp_path / "w" / "_SUCCESS").exists()
    assert sinks.delete_parts(spark, f"{tmp_path}/nowhere") == 0


def test_side_table_takes_the_last_row(spark, tmp_path):
    (tmp_path / "s").write_text("a,9,x\nb,1,y\na,1,z\n")
    assert {tuple(r) for r in delimited.side_table(spark, f"{tmp_path}/s", [0], [1, 2]).collect()} == {("a", "1,z"), ("b", "1,y")}


def test_written_tables_go(spark):
    import os

    from larkspur.session import drop_all, scratch, shared_folder, written

    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    with scratch(spark):
        a, b = written(spark.range(3)), written(spark.range(4), keep=True)
        with scratch(spark):
            c = written(spark.range(5), keep=True)
            d = written(spark.range(6))
        assert there(a) and there(c) and not os.path.exists(os.path.dirname(d.inputFiles()[0]).removeprefix("file://")) if d.inputFiles() else True
        files = [x.inputFiles()[0].removeprefix("file://") for x in (a, b, c)]
    assert [os.path.exists(f) for f in files] == [False, True, False]
    drop_all(spark)
    assert not os.path.exists(files[1]) and not os.path.exists(f"{shared_folder(spark).removeprefix('file://')}/larkspur/{spark.sparkContext.applicationId}")
