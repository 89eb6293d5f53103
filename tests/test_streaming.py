from pyspark.sql import functions as F

from larkspur.operators.joins import Target
from larkspur.streaming import operators as so


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_lookup_and_counts(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:01:00"), (2, "b", "2024-01-01 00:02:00"), (3, "a", "2024-01-01 00:07:00"), (4, "a", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "id int, k string, t string").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    side = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string")
    assert sorted(map(tuple, run(spark, so.stream_lookup(stream, ["k"], [Target(side, ["k"], ["v"], "outer")]).select("id", "v"), "looked", "append").collect())) == [(1, "x"), (2, "null"), (3, "x"), (4, "x")]
    got = run(spark, so.windowed_count(stream, "ts", "k", "5 minutes", "1 minute"), "counted", "update")
    assert sorted((r["k"], r["n"]) for r in got.collect()) == [("a", 1), ("a", 1), ("a", 1), ("b", 1)]
    assert run(spark, so.first_seen(stream, "k", "ts", "1 day"), "seen", "append").count() == 2
    out = []
    so.to_batches(stream.select("id"), lambda b, n: out.extend(r["id"] for r in b.collect()), f"{tmp_path}/ck").awaitTermination()
    assert sorted(out) == [1, 2, 3, 4]
