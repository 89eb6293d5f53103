import bisect
import zlib

import numpy as np
import pytest

from larkspur.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("text", ["", " ", "a  b", "\n a", "a \n b ", "it's  John's", "a  b", "\x1c x", "tab\t x", "漢字 かな", "<|endoftext|> x", "  lead", "trail  ", "a\r\n\r\nb", "x" * 500, "🙂 🙂"])
def test_ids_are_the_library_s(library, text):
    assert packing.byte_bpe().ids(text) == ids_of(library, text)[:-1].tobytes()


def check(rows, texts, library, most=2048):
    """Every piece in place, all ids there, sequences gapless. texts: a list of (doc_id, text)."""
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(ids_of(library, t))
    assert got.keys() == want.keys()
    for d, own in want.items():
        pieces = sorted((r["start"], r["piece"], r["length"], r["ids_crc32"]) for r in got[d])
        assert pieces == sorted((s, k, n, zlib.crc32(ids[s : s + n].tobytes())) for ids in own for k, (s, n) in enumerate(packing.cuts(len(ids), most)))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= most
    return len(by_sequence)


def test_documents(spark, sf, documents, texts, library):
    rows = packing.op1(spark, sf).collect()
    used = check(rows, texts.items(), library)
    assert used <= best_fit_decreasing([r["length"] for r in rows], 2048) * 1.005 + 1


def test_nasty(nasty, nasty_rows, library):
    check(packing.pack(nasty, 64).collect(), [r[:2] for r in nasty_rows], library, 64)


def test_empty(empty):
    assert packing.pack(empty).collect() == []


def test_cuts():
    assert packing.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]


def best_fit_decreasing(lengths, most):
    """The number of sequences, by one document after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else most) - n)
    return len(gaps)


def one_by_one(runs, most):
    """The sweep without runs: each gap takes the longest document that waits, of equal ones the last in rank."""
    waiting, out = [], set()
    for size, kind, number in sorted((size, kind, first + i) for kind, size, first, n in runs for i in range(n)):
        if kind == 0:
            waiting.append((size, number))
        elif waiting:
            out.add((*waiting.pop(), number, most - size))
    return out


def each(placed):
    return {(length, rank + i, sequence + i, offset) for _, length, rank, n, sequence, offset in placed for i in range(n)}


def alike(a, b):
    """The same gaps take documents of the same lengths, and the same documents are placed; which of equal ones goes where is open."""
    return len(a) == len(b) and all({tuple(x[i] for i in own) for x in a} == {tuple(x[i] for i in own) for x in b} for own in ((0, 2, 3), (0, 1)))


def test_sweep_against_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        runs = [(int(rng.integers(0, 2)), int(rng.integers(1, 33)), 100 * i, int(rng.integers(1, 6))) for i in range(int(rng.integers(1, 12)))]
        got = packing.sweep(runs, 32)
        assert alike(each(r for r in got if r[0] == 2), one_by_one(runs, 32))
        # Ranges first and what they leave after give as many matches, each into a gap that is large enough.
        parts = [packing.sweep([r for r in runs if (r[1] > 11) + (r[1] > 20) == k], 32) for k in range(3)]
        left = packing.sweep([r[:4] for x in parts for r in x if r[0] < 2], 32)
        assert alike(each(r for x in [*parts, left] for r in x if r[0] == 2), one_by_one(runs, 32))


@pytest.mark.parametrize("kind", ["short", "even", "few"])
def test_supersteps_against_best_fit_decreasing(spark, kind):
    rng = np.random.default_rng(1)
    lengths = {"short": np.minimum(32, 1 + rng.exponential(6, 400).astype(int)), "even": rng.integers(1, 33, 300), "few": rng.choice([7, 9, 17, 32], 300)}[kind].tolist()
    counts = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length long, n long")
    runs = packing.supersteps(counts, 32)
    assert sorted((length, rank + i) for length, rank, n, _, _ in runs for i in range(n)) == sorted((n, i) for n in set(lengths) for i in range(lengths.count(n)))
    filled = {}
    for length, _, n, sequence, offset in runs:
        for i in range(n):
            filled.setdefault(sequence + i, []).append((offset, length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 32
    assert len(filled) <= best_fit_decreasing(lengths, 32) * 1.02 + 1
