import math
import random
from fractions import Fraction

import numpy as np
import pytest

from larkspur.llm import langid


@pytest.fixture(scope="module")
def own():
    return langid.pieces()


@pytest.fixture(scope="module")
def p(own):
    x = np.random.default_rng(0).random((own.size, 2))
    return x / x.sum(axis=0)


def brute(own, word, p):
    """The sum over all segmentations in exact fractions of two: no scale is needed."""
    tree = {k: v & 0xFFFF for k, v in own.matcher.items()}
    text = "▁" + word
    total = [Fraction(1)] + [Fraction(0)] * len(text)
    for e in range(1, len(text) + 1):
        for n in range(1, min(own.longest, e) + 1):
            piece = tree.get(text[e - n : e], 0 if n == 1 else None)
            if piece is not None:
                total[e] += total[e - n] * Fraction(float(p[piece]))
    top, bottom = total[-1].numerator, total[-1].denominator
    return math.log(top) - math.log(bottom)


rnd = random.Random(1)
#: Also words of 100 letters and more, and sentences without spaces.
WORDS = ["hello", "straße", "ción", "漢字xy", "ǂǂ", "a", "ontion", "x" * 130, "ontion" * 20, "漢字" * 60, "".join(rnd.choice("abcdeßé漢字") for _ in range(150)), "hello"]


def test_forward_sums_all_segmentations(own, p):
    got = own.log_prob(WORDS, p)
    assert np.allclose(got, [[brute(own, w, p[:, k]) for k in (0, 1)] for w in WORDS], rtol=1e-9)
    assert np.isfinite(own.log_prob(["ontion" * 4000], p)).all()


def test_long_words_have_expected_counts_too(own, p):
    """Slopes of the logarithm, for a word far beyond what floating point holds unscaled."""
    word = "ontion" * 60
    counts = own.expected([word], np.ones(1), p[:, :1])
    known = {k: v & 0xFFFF for k, v in own.matcher.items()}
    for piece in {"on", "ti", "▁on", "t", "ion"} & known.keys():
        q = p[:, :1].copy()
        q[known[piece]] *= 1 + 1e-6
        slope = (own.log_prob([word], q) - own.log_prob([word], p[:, :1]))[0, 0] / 1e-6
        assert abs(counts[known[piece]] - slope) < 1e-3 * max(1, slope)


def test_expected_counts_are_the_gradient(own, p):
    counts = own.expected(["hello", "ontion"], np.array([2.0, 1.0]), p[:, :1])
    piece = {k: v & 0xFFFF for k, v in own.matcher.items()}["on"]
    q = p[:, :1].copy()
    q[piece] *= 1 + 1e-6
    slope = (own.log_prob(["ontion"], q) - own.log_prob(["ontion"], p[:, :1]))[0, 0] / 1e-6
    assert abs(counts[piece] - slope) < 1e-4 * max(1, slope)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in langid.op5(spark, d).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [got[i]["lang_pred"] == x for i, x in lang.items() if x and got[i]["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_nasty(nasty, nasty_rows, empty):
    got = langid.identify(nasty).collect()
    assert len(got) == len(nasty_rows)
    silent = {i for i, t, *_ in nasty_rows if not any(map(str.isalpha, t or ""))}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == silent and all(0 <= r["score"] <= 1 for r in got)
    kept = langid.known_language(nasty)
    assert kept.columns == nasty.columns and 0 < kept.count() < len(nasty_rows)
    assert langid.identify(empty).collect() == [] and langid.known_language(empty).collect() == []
    unlabelled = langid.identify(nasty.withColumn("lang", nasty["text"]).where("false").unionByName(nasty).drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_words_are_whole():
    assert langid.words_of("Ab" * 100 + " c") == ["ab" * 100, "c"]


def test_predictions_against_brute_force(spark, own):
    """Shares from exact sums, for texts of one script without spaces as of others; a tie goes to the language that sorts first."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat on the mat", "en"), ("der Hund und die Katze", "de"), ("漢字 日本語", "ja"), ("この漢字の文", "ja")] * 3)]
    langs, q = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en", "ja"]
    asked = ["the mat", "die Katze und", "漢字の日本語の文" * 12, "", "12 !"]
    got = langid.Scorer(langs, q).judge(asked)
    for text, (lang, share, mean) in zip(asked[:3], got):
        s = [sum(brute(own, w, q[:, k]) for w in langid.words_of(text)) for k in range(3)]
        assert langs[int(np.argmax(s))] == lang
        assert share == pytest.approx(1 / sum(math.exp(x - max(s)) for x in s), abs=1e-9)
        assert mean == pytest.approx(max(s) / sum(map(len, langid.words_of(text))))
    assert [x[:2] for x in got[3:]] == [("und", 0.0)] * 2
    tie = langid.Scorer(["aa", "bb"], np.repeat(q[:, :1], 2, axis=1)).predict(["the mat"])
    assert tie == [("aa", 0.5)]


def test_words_do_not_stay_in_memory(own, p):
    s = langid.Scorer(["x", "y"], p)
    s.most = 4
    s.log = s.log[:4]
    texts = ["hello ontion", "a b c d e f g", "x" * 100 + " hello", "hello ontion"]
    got = [s.scores([t]) for t in texts]
    assert np.allclose(got[0], got[3]) and len(s.at) <= 7 and not any(len(w) > langid.KEPT for w in s.at)
    assert np.allclose(got[2][0], own.log_prob(["x" * 100, "hello"], p).sum(axis=0))


def test_stage_fills_corrects_and_drops(spark, sf, documents):
    """On the table with some languages taken away or made wrong and with junk added: clean documents stay, lang comes back, junk goes."""
    from pyspark.sql import functions as F

    held = documents.select("doc_id", F.col("lang").alias("right")).where("doc_id % 5 < 2")
    lang = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when((F.col("doc_id") % 5 == 1) & (F.length("text") > 200), F.lit("zz")).otherwise(F.col("lang"))
    changed = documents.withColumn("lang", lang)
    junk = ["qzxv kjwq zzkw xqjv pwq xkcd qqqq wvxz", "dGhpcyBpcyBhIHRlc3QgYmFzZSBzaXh0eSBmb3Vy", "私は学生です", "12 + 34 = 46 !!", "", None]
    more = spark.createDataFrame([(-1 - i, t, None, "s", 1) for i, t in enumerate(junk)], documents.schema)
    out = {r["doc_id"]: r["lang"] for r in langid.known_language(changed.union(more)).collect()}
    n = documents.count()
    assert sum(d >= 0 for d in out) >= 0.98 * n and not any(d < 0 for d in out)
    right = {r["doc_id"]: r["right"] for r in held.collect()}
    assert np.mean([out[d] == x for d, x in right.items() if d in out]) > 0.97 and None not in out.values()
    assert {r["lang"] for r in langid.known_language(documents, wanted=["en", "fr"]).select("lang").distinct().collect()} <= {"en", "fr"}
