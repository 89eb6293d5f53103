import hashlib
import re

import numpy as np

from larkspur.llm import exact


def brute(rows):
    """(doc_id, text): a set of (doc_id, keep_id, group_size, sha) and the number kept of each group."""
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d or 0))
    return sorted(
        ((d, None if min(g)[1] else min(g)[2], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for d in [None if x[1] else x[2] for x in g]), key=repr
    )


def check(df, rows, **kind):
    got = exact.duplicates(df, **kind).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert {r["text_sha256"] for r in kept} == {r["text_sha256"] for r in got}


def test_documents(documents, texts):
    check(documents, list(texts.items()))


def test_nasty(nasty, nasty_rows):
    check(nasty, [r[:2] for r in nasty_rows], capacity=1)
    kept = exact.dedup(nasty)
    assert kept.columns == nasty.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in nasty_rows})


def test_empty(empty):
    assert exact.duplicates(empty).collect() == [] and exact.dedup(empty).collect() == []


def test_collisions_are_told_by_bytes():
    import pyarrow as pa

    rows = [(3, 7, b"a", 0, 0, 2, 1, 5, 0), (3, 7, b"b", 0, 1, 1, 1, 6, 1), (3, 7, b"a", 1, 0, 1, 3, 9, 0), (4, 8, b"c", 1, 1, 1, 1, 2, 1)]
    names = ["bucket", "h", "norm", "chunk", "slot", "n", "best_cp", "best_id", "best_row"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2])], names) for i in (0, 2)]
    found = [r for b in exact._own(iter(batches)) for r in b.to_pylist()]
    assert {(r["bucket"], r["h"]) for r in found} == {(3, 7), (4, 8)}
    got = {(r["chunk"], r["slot"]): (r["keep_id"], r["group_size"]) for r in found}
    assert got == {(0, 0): (9, 3), (1, 0): (9, 3), (0, 1): (6, 1), (1, 1): (2, 1)}


def test_directory():
    counts = np.zeros(16, np.int64)
    counts[:4], counts[9] = [3, 3, 3, 3], 50
    d = exact.Directory(capacity=6)
    d.grow(counts)
    assert d.depth == 4 and d.overfull(counts)
    entries = d.entries()
    assert len(entries) == 16 and (np.diff(entries) >= 0).all()
    for p, depth in d.buckets:
        assert counts[p << (4 - depth) : (p + 1) << (4 - depth)].sum() <= 6 or depth == 4
    assert exact.Directory(100).entries().tolist() == [0]


def test_owners_are_key_ranges_of_like_size():
    rng = np.random.default_rng(3)
    counts, sizes = rng.integers(0, 20, 64), rng.integers(0, 5000, 64)
    d = exact.Directory(capacity=15)
    d.grow(counts)
    owner = d.owners(sizes, 4, 20_000)
    entries = d.entries()
    assert (np.diff(owner) >= 0).all() and owner[0] == 0 and (np.diff(owner) <= 1).all()
    assert all(len(set(owner[entries == x])) == 1 for x in set(entries))
    held = np.bincount(owner, np.add.reduceat(sizes, np.arange(0, 64, 64 >> d.depth)))
    assert len(held) > 4 and held.max() <= 20_000 + np.add.reduceat(sizes, np.unique(entries) << (6 - d.depth)).max()
    assert exact.Directory().owners(np.zeros(4096, np.int64), 8).tolist() == [0]


def test_index_on_shared_files(spark, documents, texts):
    """Files hold key ranges; later documents are probed against them."""
    from pyspark.sql import functions as F

    built = exact.indexed(documents, capacity=4, owner_bytes=50_000)
    _, directory, index = built
    n = directory.count()
    assert n & (n - 1) == 0 and n > 16
    ranges = index.groupBy(F.input_file_name().alias("f")).agg(F.min(F.shiftrightunsigned("h", 1)).alias("a"), F.max(F.shiftrightunsigned("h", 1)).alias("b")).orderBy("a").collect()
    assert len(ranges) > 3 and all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:]))
    some = list(texts.items())[:40]
    new = [(1_000_000 + d, f" {t}\n" if d % 2 else t) for d, t in some] + [(5, "in no document at all"), (6, None), (None, some[0][1])]
    got = {r["doc_id"]: r["keep_id"] for r in exact.probe(spark.createDataFrame(new, "doc_id long, text string"), built).collect()}
    keep = {r["doc_id"]: r["keep_id"] for r in exact.duplicates(documents).collect()}
    assert got == {**{1_000_000 + d: keep[d] for d, _ in some}, 5: None, 6: next((keep[d] for d, t in texts.items() if not (t or "").strip()), None), None: keep[some[0][0]]}
