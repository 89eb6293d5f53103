import re

import numpy as np
import xxhash

from larkspur.llm import simhash


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps, ids, radius=2):
    """The least id that links reach, all pairs compared."""
    a, up = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            up[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(a))]


def similar(texts, words=5, least=0.8):
    """For each text the place of the first one of its group, all pairs compared."""
    sets, up = [], list(range(len(texts)))
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def check(df, rows):
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    fps = [brute(t) for _, t in rows]
    assert got == sorted(zip([d for d, _ in rows], fps, groups(fps, [d for d, _ in rows])), key=repr)


def test_documents(spark, sf, documents, texts):
    check(documents, list(texts.items()))
    assert all(len(r["fingerprint"]) == 16 for r in simhash.op6(spark, sf).collect())


def test_nasty(nasty, nasty_rows, empty):
    check(nasty, [r[:2] for r in nasty_rows])
    kept = simhash.near_dedup(nasty)
    assert kept.columns == nasty.columns and kept.schema == nasty.schema
    want = similar([r[1] for r in nasty_rows])
    assert kept.count() == len(set(want))
    first = {}
    for r, g in zip(nasty_rows, want):
        first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())) == sorted(first.values())
    assert simhash.near_duplicates(empty).collect() == [] and simhash.near_dedup(empty).collect() == []


def test_links_and_chains(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:10]:  # balls and chains about some of them
        x = int(b)
        for k in range(20):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.add(x)
            fps.add(int(b) ^ 1 << k)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for tile in (3, 4096):
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)
        pairs = [(r["u"], r["v"]) for r in edges.collect()]
        assert all(((u ^ v) % 2**64).bit_count() <= 2 for u, v in pairs)
        roots = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
        want = groups(fps, list(range(len(fps))))
        for i, f in enumerate(signed):
            assert (roots.get(f, f) == f) == (min(x for x, w in zip(signed, want) if w == want[i]) == f)
        got = [roots.get(f, f) for f in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_forest_connects_all_and_stays_small():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 8, 40, dtype=np.uint64))
    assert len(simhash.forest(a, None, 64)) == len(a) - 1
    b = np.arange(100, 130, dtype=np.uint64)
    assert len(simhash.forest(a, b, 64)) <= len(a) + len(b)


def test_one_id_in_two_groups_keeps_both(spark):
    rows = [(5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (6, "one two three four five six"), (5, "one two three four five six")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted(set(rows[:2]))


def test_similar_groups_against_brute_force(spark, documents, texts):
    rng = np.random.default_rng(4)
    rows = list(texts.items())
    long = [t for _, t in rows if t and len(t.split()) > 200][:6]
    for n, t in enumerate(long):  # near copies of them, some of those of copies
        words = t.split()
        for k in range(12):
            new = list(words)
            for i in rng.choice(len(new), max(1, len(new) * (k % 6) // 150), replace=False):
                new[i] = f"changed{k}"
            rows.append((10**6 + 100 * n + k, " ".join(new)))
            words = new if k % 3 == 2 else words
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df).collect()}
    want = similar([t for _, t in rows])
    pairs = set(zip([got[d] for d, _ in rows], want))
    assert len(pairs) == len(set(want)) == len(set(got.values())) < len(rows) - 40


def test_tightest_is_a_minimum_spanning_forest():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (4, simhash.WIDE)).astype(np.uint64)
    rows = np.repeat(base, 15, axis=0)
    for r in rows:
        for bit in rng.integers(0, 64, 6):
            r[int(rng.integers(simhash.WIDE))] ^= np.uint64(1) << np.uint64(bit)
    d = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2).astype(int)
    up, weight = list(range(len(rows))), 0
    find = lambda x: x if up[x] == x else find(up[x])
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(rows)) for j in range(i)):
        if w <= 40 and find(i) != find(j):
            up[find(i)], weight = find(j), weight + w
    found = simhash.tightest(rows, None, 40)
    assert sum(d[i, j] for i, j in found) == weight and len(found) == len(rows) - len({find(i) for i in range(len(rows))})
    split = simhash.tightest(rows[:30:2], rows[1:30:2], 40)
    assert len(split) == 28


def test_a_failed_link_keeps_no_similar_pair_apart(spark):
    rng = np.random.default_rng(68)
    new = lambda n: [f"w{rng.integers(10**6)}" for _ in range(n)]
    a = new(200)

    def altered(n):
        t, at = list(a), rng.integers(0, 200 - n)
        t[at : at + n] = new(n)
        return t

    c, b = altered(16), altered(17)
    rows = [(i, " ".join(t)) for i, t in enumerate((a, b, c))]
    sets = [simhash.shingle_hashes(t) for _, t in rows]
    bits = [np.array(simhash.wide_fingerprint(s), np.uint64) for s in sets]
    far = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]).sum()
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    # 0 and 1 are similar, but both are nearer to 2 in bits, and 1 and 2 are not similar.
    assert far(0, 2) < far(1, 2) < far(0, 1) <= simhash.WIDE_RADIUS and jaccard(0, 1) >= 0.8 > jaccard(1, 2)
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["root"] for r in got}) == 1


def test_alike_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = [rng.choice(10**6, 60, replace=False).astype(np.uint32) for _ in range(5)]
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 10**6, 60), base[k % 5])).astype(np.uint32) for k in range(40)] + [np.zeros(0, np.uint32)] * 2
    kind = np.array([*range(37), 0, 1, 2, 40, 41])

    def groups_of(links, n):
        label = {k: k for k in kind[:n].tolist()}
        for i, j in links:
            x, y = label[kind[i]], label[kind[j]]
            label = {k: y if g == x else g for k, g in label.items()}
        return {frozenset(k for k in label if label[k] == g) for g in label.values()}

    near = [(i, j) for i in range(42) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    links = simhash.alike(sets, None, kind, None, 0.8)
    assert groups_of(links, 42) == groups_of(near, 42) and len(links) < 42
    across = [(i, j) for i, j in near if (i < 20) != (j < 20)]
    assert groups_of(simhash.alike(sets[:20], sets[20:], kind[:20], kind[20:], 0.8), 42) == groups_of(across, 42)


def test_bundles_of_a_hot_cell_lose_no_link(spark, monkeypatch):
    """All fingerprints in one cell, in more tiles than a bundle holds."""
    monkeypatch.setattr(simhash, "BUNDLE", 3)
    rng = np.random.default_rng(5)
    own = set()
    while len(own) < 400:
        ones = np.concatenate([rng.choice(16, 8, replace=False) + 16 * k for k in range(4)])
        x = int(sum(1 << int(b) for b in ones))
        own.add(x)
        if rng.random() < 0.3:  # one bit moved inside its segment: the same cell, two bits apart
            free = [b for b in range(16) if not x >> b & 1]
            own.add(x ^ (1 << int(ones[0])) ^ (1 << free[0]))
    a = np.array(sorted(own), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    assert df.select(simhash._cell(4).alias("c")).distinct().count() == 1
    edges = simhash.links(df, tile=16)
    roots = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    signed = a.view(np.int64).tolist()
    for i, x in enumerate(signed):
        for j in np.flatnonzero(near[i]):
            assert roots.get(x, x) == roots.get(signed[j], signed[j])
    assert sum(near.sum(axis=1) > 1) == len(roots) + len(set(roots.values()))


def test_short_near_copies_are_candidates(spark):
    """Eight words against nine: four of five shingles in common, a similarity of exactly 0.8, in 600 pairs."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        words = [f"w{int(x)}" for x in rng.integers(0, 10**9, 9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(600)}
