import random

import pytest

#: Names that the operators use inside or return.
CLASHING = ["keep_id", "piece", "fp", "th", "cell", "u", "d", "h1", "length", "rank", "part", "score", "component_id", "k_id", "chunk", "spans", "held_out", "runs", "uid", "y", "n"]


@pytest.fixture(scope="session")
def nasty_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "on", "er", "ción", "ß", "é", "漢"]) for _ in range(rnd.randint(1, 4)))
    texts = [None, "", "   \n\t ", "a", "a", "\x00\x0b￿▁ ▁", "x" * 3000, "漢" * 2000, " ".join(word() for _ in range(6000)), "\n".join("same line of words " * 9 for _ in range(40)), "Mail me: a.b@c.example.com, +1 (017) 555-7713"]
    texts += [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [texts[12], texts[12], texts[12] + " ", texts[12].upper(), texts[13] + " tail"]
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (12, texts[12], "en", "s", 1), (12, texts[12], "en", "s", 1), (None, texts[13], None, None, None), (None, None, None, None, None), (-(2**63), "low", "en", "s", 3), (2**63 - 1, "high id", "en", "s", 7)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
