import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from larkspur.llm import pieces
from larkspur.llm.packing import vocabulary_path


@pytest.fixture(scope="module")
def own():
    return pieces.vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


rnd = random.Random(2)
TEXTS = ["", "  a", " ", "a\n\n b\t", "\x00xy ", "Hello world  straße 漢字", "x" * 200, "字" * 100 + " " * 40 + "z", "￿", "a b", "<s> </s> <0x41>", "=" * 90 + "---" * 30, "0123456789" * 20, "aaab" * 50]
TEXTS += ["".join(rnd.choice(rnd.choice(["ab", "the int on", "字\né", " a", "   x", "=-_*/."])) for _ in range(rnd.randint(1, 90))) for _ in range(80)]
MARKED = ["▁", "a▁b", "x ▁ y▁▁", "▁" * 40]


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_the_library_gives_the_same_ids(own, library, texts):
    some = [*TEXTS, *(t or "" for t in texts.values())]
    for text, ids in zip(some, own.encode(some)):
        assert numbers(ids) == library.encode(text)
        assert own.decode(ids) == text


def test_mark_in_the_text(own, library):
    """The library takes it for a space; here it becomes its bytes and comes back."""
    for text, ids in zip(MARKED, own.encode(MARKED)):
        assert own.decode(ids) == text
        parts = [library.encode(x)[1:] if k else library.encode(x) for k, x in enumerate(text.split("▁"))]
        assert numbers(ids).count(own.byte["▁".encode()[0]]) == text.count("▁") and sum(map(len, parts)) <= len(numbers(ids))


def test_neighbours_fit(own):
    """fit() against merging the joined characters."""
    some = random.Random(4).sample(sorted(own.left), 300)
    for a, b in zip(some, some[1:] + some[:1]):
        joined = [own.text[a], own.text[b]]
        assert own.fit(a, b) == (own.merged("".join(joined))[0] == joined), joined
    a, b = np.array([some[0], -1, own.start]), np.array([some[1], some[1], some[2]])
    assert own.fits(a, b).tolist() == [own.fit(some[0], some[1]), False, True] == own.fits(a, b).tolist()


@pytest.mark.parametrize("chunk", [1, 7, 64, 256])
def test_ids_do_not_depend_on_the_chunks(spark, own, chunk):
    rows = [*enumerate(TEXTS + MARKED), (None, TEXTS[7]), (-1, None)]
    got = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string"), giant=2, chunk=chunk)
    assert {r["doc_id"]: bytes(r["ids"]) for r in got.collect()} == {d: own.encode([t or ""])[0] for d, t in rows}
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(got).collect()}
    assert back[5] == TEXTS[5]


def test_text_over_giant(spark, library):
    """At the production sizes: more than four chunks, one of the texts without a space."""
    rnd = random.Random(8)
    words = ["the", "ontion", "straße", "漢字", "erhe,", "a", " "]
    rows = [(0, " ".join(rnd.choice(words) for _ in range(20_000))), (1, "".join(rnd.choice("漢字ab=1") for _ in range(pieces.GIANT + 9)))]
    assert all(len(t) > pieces.GIANT for _, t in rows)
    got = {r["doc_id"]: bytes(r["ids"]) for r in pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert numbers(got[d]) == library.encode(t)


def test_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 8, 13, 70):
        m = rng.normal(size=(n, 4, 4))
        states = pieces.scan(m)
        best = np.array([0.0, -np.inf, -np.inf, -np.inf])
        for x in m:
            best = (best[:, None] + x).max(axis=0)
        assert states[0] == 0 and len(states) == n + 1 and states[-1] == best.argmax()
        assert abs(sum(m[i, states[i], states[i + 1]] for i in range(n)) - best.max()) < 1e-9


def test_documents(spark, sf, texts):
    got = {r["doc_id"]: r["decoded_sha256"] for r in pieces.op9(spark, sf).collect()}
    assert got == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items()}


def test_nasty(nasty, nasty_rows, empty, own):
    got = sorted(((r["doc_id"], own.decode(bytes(r["ids"]))) for r in pieces.encoded(nasty, giant=1000, chunk=256).collect()), key=repr)
    assert got == sorted(((r[0], r[1] or "") for r in nasty_rows), key=repr)
    assert pieces.round_trip(empty).collect() == []
