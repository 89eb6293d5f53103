"""Near-duplicate groups by SimHash fingerprints and tiled exact comparison.

A fingerprint's population counts, taken over equal segments of its 64 bits, form its cell. Two fingerprints at most
`radius` bits apart have cells at most `radius` apart in the sum of absolute differences, so tiles of other cells are
skipped and no link is lost. The tiles that are left are compared by exclusive-or and bit counts in numpy. A task
reports a spanning forest of the links of a tile pair, never all pairs of a group; components come from star
contraction, each round written to the shared folder.

Groups by similarity (`similar_groups`, which the pipeline's stage takes) use wider fingerprints of five-word shingles to
find candidates in tiles, and check each candidate's Jaccard similarity on the shingles themselves.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows get the same
component; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, drop_written, id_text, scratch, table, written
from larkspur.llm.rows import SPARK_SEED, keep_rows, sifted

WORDS, SEED, RADIUS, SEGMENTS, TILE = 3, 42, 2, 4, 4096
#: Of groups by similarity: five words, 0.8; 4 x 64 bits. Sets of similarity 0.8 differ in 39 bits of 256 on average, with
#: a deviation of 6; other texts in 128, with a deviation of 8. Of the first 64 bits the like differ in 10, deviation 3.
SIMILAR_WORDS, SIMILAR, WIDE, WIDE_RADIUS, FIRST_RADIUS = 5, 0.8, 4, 68, 22
#: Sets of up to FEW shingles differ in more: by exact binomials in 48 bits, deviation 6, where 4 and 5 of them are nested.
FEW, FEW_RADIUS, FEW_FIRST = 24, 84, 31
SIMILAR_TILE, BUNDLE, SET_TILE = 2048, 16, 256
_CHUNK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it; zero without a word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    return _majority(np.array(_digests(parts, words, seed), np.uint64)) if parts else 0


def _digests(parts: list[bytes], words: int, seed: int) -> list[int]:
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    return [digest(joined[a:b], seed) for a, b in zip((end - size)[: 1 - words].tolist(), end[words - 1 :].tolist())]


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    h = h.astype("<u8")
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        count += np.unpackbits(h[i : i + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text").to_pylist()
        th = np.fromiter((xxhash.xxh64_intdigest(t, SPARK_SEED) for t in text), np.uint64, len(text))
        fp = np.fromiter((fingerprint(t, words, seed) for t in text), np.uint64, len(text))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(th.view(np.int64)), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return by_batch(id_text(docs), run, "doc_id long, th long, fp long")


def _cell(segments: int):
    """The population counts of the segments, as digits of a number."""
    width = 64 // segments
    cell = F.lit(0)
    for i in range(segments):
        cell = cell * (width + 1) + F.bit_count(F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND((1 << width) - 1))
    return cell.cast("long")


def _steps(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of cells that fingerprints within the radius can have, one of each opposite pair."""
    full = [s for s in itertools.product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, s)) <= radius]
    return [s for s in full if s >= tuple(-x for x in s)]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between a and b (None: within a) that connect all that the links connect."""
    same = b is None
    b = a if same else b
    label = np.arange(len(b))
    found = []
    block = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), block):
        near = np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(at, min(at + block, len(a)))[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[i])
            kinds, first = np.unique(label[js], return_index=True)
            own = label[at + i] if same else kinds[0]
            found += [(int(a[at + i]), int(b[j])) for j, k in zip(js[first], kinds) if not (same and k == own)]
            if kinds[-1] != own or kinds[0] != own:
                label[np.isin(label, np.append(kinds, own))] = min(kinds[0], own)
    return found


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """u, v: fingerprints at most radius bits apart, as many as connect the same. fps: distinct fingerprints (fp)."""
    base = 64 // segments + 1
    celled = fps.withColumn("cell", _cell(segments))
    # At most base ** segments cells exist, however many fingerprints there are: a bounded broadcast.
    counts = written(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts")), "simhash-cells")
    tiles = (
        celled.join(F.broadcast(counts), "cell")
        .select("cell", F.pmod(F.xxhash64("fp"), "parts").alias("part"), "fp")
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = written(tiles, "simhash-tiles")
    steps = [sum(x * base**k for k, x in enumerate(s)) for s in _steps(segments, radius)]
    # A tile goes to each bundle of BUNDLE tiles that it may have links to, so that a cell of any size is many tasks' work.
    bundles = counts.select(F.col("cell").alias("cell_b"), F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / BUNDLE))).alias("bundle"))
    a = tiles.withColumn("cell_b", F.explode(F.array(*[F.col("cell") + s for s in steps]))).join(F.broadcast(bundles) if _few(bundles) else bundles, "cell_b")
    b = tiles.select(F.col("cell").alias("cell_b"), F.floor(F.col("part") / BUNDLE).alias("bundle"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b"))
    pairs = a.join(b, ["cell_b", "bundle"]).where("cell <> cell_b OR part <= part_b").select(F.expr("cell = cell_b AND part = part_b").alias("same"), "fps", "fps_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        left, right = batch.column("fps"), batch.column("fps_b")
        for i, same in enumerate(batch.column("same").to_pylist()):
            x = left[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            y = None if same else right[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            found += forest(x, y, radius)
        uv = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(uv.min(axis=1)), pa.array(uv.max(axis=1))], ["u", "v"])

    return by_batch(pairs, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root: for every vertex of the edges (u, v) the smallest vertex of its component, by star contraction."""
    edges = written(edges.select("u", "v"), "stars")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v")
        down = large.distinct()
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        new = written(small, "stars")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = new
        if mark == seen:
            return edges.select("v", F.col("u").alias("root"))
        seen = mark


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, th, fp, root (smallest fingerprint of the component), component_id (smallest doc_id that links reach, itself included)."""
    marked = written(fingerprints(docs, words, seed), "simhash")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    with scratch(docs.sparkSession):
        edges = written(links(firsts.select("fp"), radius, segments), "links", keep=True)
    if edges.isEmpty():
        named = firsts.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    else:
        roots = components(edges)
        rooted = written(firsts.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
        named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def shingle_hashes(text: str, words: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of the shingles, ascending; of fewer words the whole sequence is one shingle, of none there is none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(np.array(_digests(parts, words, seed), np.uint64))


def wide_fingerprint(hashes: np.ndarray, width: int = WIDE) -> list[int]:
    """width times 64 bits from the hashes, each mixed anew for every 64 bits."""
    out = []
    for k in range(width):
        x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def tightest(a: np.ndarray, b: np.ndarray | None, radius: int, first: int = FIRST_RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that form a minimum spanning forest of the rows (places in a, then in b) that have any between a and b (None: within a)."""
    other = a if b is None else b
    near_a, near_b = np.zeros(len(a), bool), np.zeros(len(other), bool)
    block = max(1, (1 << 19) // max(1, len(other)))
    for at in range(0, len(a), block):
        # The first 64 bits settle most pairs: their distance is at most that of all bits.
        i, j = np.nonzero(np.bitwise_count(a[at : at + block, None, 0] ^ other[None, :, 0]) <= first)
        i += at
        if b is None:
            i, j = i[j > i], j[j > i]
        close = np.bitwise_count(a[i] ^ other[j]).sum(axis=1) <= radius
        near_a[i[close]] = True
        near_b[j[close]] = True
    if b is None:
        at = np.flatnonzero(near_a | near_b)
        rows = a[at]
    else:
        at = np.concatenate([np.flatnonzero(near_a), len(a) + np.flatnonzero(near_b)])
        rows = np.concatenate([a[near_a], b[near_b]])
    found: list[tuple[int, int]] = []
    if len(rows):
        left = np.arange(len(rows))
        best, link = np.full(len(rows), radius + 1), np.full(len(rows), -1)
        while len(left):
            k = int(np.argmin(best[left]))
            x = left[k]
            if best[x] <= radius:
                found.append((int(at[link[x]]), int(at[x])))
            left = np.delete(left, k)
            d = np.bitwise_count(rows[left] ^ rows[x]).sum(axis=1)
            nearer = d < best[left]
            best[left[nearer]], link[left[nearer]] = d[nearer], x
    return found


def alike(a: list[np.ndarray], b: list[np.ndarray] | None, kind_a: np.ndarray, kind_b: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links (places in a, then in b) of sets with a Jaccard similarity of at least `least` between a and b (None: within a) that connect all that such links connect.

    Sets of one kind count as linked already. Every other pair is compared, unless links that are found join it first.
    """
    same = b is None
    sets = a if same else a + b
    _, label = np.unique(kind_a if same else np.concatenate([kind_a, kind_b]), return_inverse=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, word = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(len(vocabulary) + 1, np.int64)
    found = []
    for i in range(len(a)):
        js = np.arange(i + 1 if same else len(a), len(sets))
        js = js[(label[js] != label[i]) & (np.minimum(size[js], size[i]) >= least * np.maximum(size[js], size[i]))]
        if not len(js):
            continue
        marked[word[start[i] : start[i + 1]]] = 1
        so_far = np.concatenate([[0], np.cumsum(marked[word[start[js[0]] : start[js[-1] + 1]]])])
        both = so_far[start[js + 1] - start[js[0]]] - so_far[start[js] - start[js[0]]]
        marked[:] = 0
        for j in js[both >= least * (size[js] + size[i] - both)]:
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def left_apart(found: DataFrame, good: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """u, v (uid): the links that candidates of found still lack where some of its links failed the check; None where none failed.

    found connects all candidates; good are its links that passed. Where links of found join several groups of good,
    every pair of texts between these groups is compared on the shingles, for a pair may pass though a nearer link failed.
    """
    failed = written(found.join(good, ["u", "v"], "left_anti"), "similar-failed")
    if failed.isEmpty():
        return None
    root = written(components(good).withColumnRenamed("v", "uid"), "similar-roots") if not good.isEmpty() else good.select(F.col("u").alias("uid"), F.col("v").alias("root"))
    kind = lambda end: root.select(F.col("uid").alias(end), F.col("root").alias(f"kind_{end}"))
    between = failed.join(kind("u"), "u", "left").join(kind("v"), "v", "left").select(F.coalesce("kind_u", "u").alias("u"), F.coalesce("kind_v", "v").alias("v"))
    between = written(between.where("u <> v").distinct(), "similar-between")
    if between.isEmpty():
        return None
    area = components(between).select(F.col("v").alias("kind"), F.col("root").alias("area"))
    area = area.union(area.select("area", "area").distinct())
    size = F.length("own") / 4
    cell = F.when(size > 0, F.floor(F.log(size) / float(np.log(1 / least)) + 1e-9)).otherwise(-5)
    rows = sets.join(root, "uid", "left").select("uid", "own", F.coalesce("root", "uid").alias("kind"), cell.alias("cell")).join(area, "kind")
    rows = written(rows, "similar-apart")
    key = ["area", "cell"]
    counts = written(rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SET_TILE).alias("parts")), "similar-parts")
    tiles = rows.join(counts, key).groupBy(*key, F.pmod(F.xxhash64("uid"), "parts").alias("part")).agg(F.collect_list(F.struct("uid", "kind", "own")).alias("x"))
    tiles = written(tiles.select(*key, "part", *[F.col(f"x.{c}").alias(c) for c in ("uid", "kind", "own")]), "similar-set-tiles")
    bundles = counts.select("area", F.col("cell").alias("cell_b"), F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / BUNDLE))).alias("bundle"))
    a = tiles.withColumn("cell_b", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).join(bundles, ["area", "cell_b"])
    b = tiles.select("area", F.col("cell").alias("cell_b"), F.floor(F.col("part") / BUNDLE).alias("bundle"), *[F.col(c).alias(c + "_b") for c in ("part", "uid", "kind", "own")])
    same = F.expr("cell = cell_b AND part = part_b")
    pairs = a.join(b, ["area", "cell_b", "bundle"]).where("cell <> cell_b OR part <= part_b").select(same.alias("same"), "uid", "kind", "own", "uid_b", "kind_b", "own_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v = [], []
        numbers = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        shingles = lambda name, i: [np.frombuffer(x, np.uint32) for x in batch.column(name)[i].as_py()]
        for i, same in enumerate(batch.column("same").to_pylist()):
            ids = numbers("uid", i) if same else np.concatenate([numbers("uid", i), numbers("uid_b", i)])
            for p, q in alike(shingles("own", i), None if same else shingles("own_b", i), numbers("kind", i), None if same else numbers("kind_b", i), least):
                u.append(min(ids[p], ids[q]))
                v.append(max(ids[p], ids[q]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return by_batch(pairs, run, "u long, v long").distinct()


def similar_links(docs: DataFrame, marked: DataFrame, words: int, least: float, radius: int, tile: int = SIMILAR_TILE) -> DataFrame:
    """u, v (uid): texts whose shingles have a Jaccard similarity of at least `least`, as many as connect the same.

    Sets that similar have sizes in that ratio at least, so tiles of other classes of size are skipped, as are those whose
    population counts differ beyond the radius. In each tile pair the minimum spanning forest by bits is kept: where two
    texts are similar, a path of links with no more bits each joins them. Each link is then checked on the shingles. Where
    one fails, all pairs that it may have kept apart are compared on the shingles too (`left_apart`).
    """
    base = 1 / least
    size = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / float(np.log(base)) + 1e-9)).otherwise(-5)
    ones = sum((F.bit_count(F.col("w")[k]) for k in range(WIDE)), F.lit(0))
    celled = marked.select("uid", "w", size.alias("cell"), F.floor(ones / 32).alias("ones"))
    # Classes of size and of population count: some hundred at any number of texts.
    counts = celled.groupBy("cell", "ones").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    tiles = (
        celled.join(F.broadcast(counts), ["cell", "ones"])
        .groupBy("cell", "ones", F.pmod(F.xxhash64("uid"), "parts").alias("part"))
        .agg(F.collect_list(F.struct("uid", "w")).alias("own"))
        .select("cell", "ones", "part", F.transform("own", lambda x: x["uid"]).alias("uids"), F.flatten(F.transform("own", lambda x: x["w"])).alias("ws"))
    )
    tiles = written(tiles, "similar-tiles")
    # A tile goes to each bundle of BUNDLE tiles that it may have links to, so that a class of any size is many tasks' work.
    bundles = counts.select(F.col("cell").alias("cell_b"), F.col("ones").alias("ones_b"), F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / BUNDLE))).alias("bundle"))
    few = int(np.floor(np.log(FEW) / np.log(base)))  # the class of size up to which the wider radius holds
    reach = f"CASE WHEN cell <= {few} THEN greatest({radius}, {FEW_RADIUS}) ELSE {radius} END"
    apart = f"(greatest(ones, ones_b) - least(ones, ones_b) - 1) * 32 < {reach}"
    a = tiles.withColumn("cell_b", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).join(bundles, "cell_b").where(apart)
    b = tiles.select(
        F.col("cell").alias("cell_b"), F.col("ones").alias("ones_b"), F.floor(F.col("part") / BUNDLE).alias("bundle"), F.col("part").alias("part_b"), F.col("uids").alias("uids_b"), F.col("ws").alias("ws_b")
    )
    once = "(cell <> cell_b OR (ones, part) <= (ones_b, part_b))"
    same = F.expr("cell = cell_b AND ones = ones_b AND part = part_b")
    pairs = a.join(b, ["cell_b", "ones_b", "bundle"]).where(once).select(same.alias("same"), F.expr(f"cell <= {few}").alias("few"), "uids", "ws", "uids_b", "ws_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v = [], []
        values = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        for i, (same, short) in enumerate(zip(batch.column("same").to_pylist(), batch.column("few").to_pylist())):
            ids = values("uids", i) if same else np.concatenate([values("uids", i), values("uids_b", i)])
            x = values("ws", i).view(np.uint64).reshape(-1, WIDE)
            reach = (max(radius, FEW_RADIUS), max(FIRST_RADIUS, FEW_FIRST)) if short else (radius, FIRST_RADIUS)
            for p, q in tightest(x, None if same else values("ws_b", i).view(np.uint64).reshape(-1, WIDE), *reach):
                u.append(min(ids[p], ids[q]))
                v.append(max(ids[p], ids[q]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    found = written(by_batch(pairs, run, "u long, v long").distinct(), "similar-candidates")
    asked = written(found.select(F.explode(F.array("u", "v")).alias("uid")).distinct().join(marked.select("uid", "doc_id", "th"), "uid"), "similar-asked")
    texts = sifted(id_text(docs), asked).withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])
    sets = texts.join(asked.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("uid", "text")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(shingle_hashes(t, words).astype(np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(own, pa.binary())], ["uid", "own"])

    sets = written(by_batch(sets, hashed, "uid long, own binary"), "similar-sets")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= least * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = found.join(sets.select(F.col("uid").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("uid").alias("v"), F.col("own").alias("y")), "v")
    good = written(by_batch(both.select("u", "v", "x", "y"), check, "u long, v long"), "similar-checked")
    more = left_apart(found, good, sets, least)
    return good if more is None else good.union(more)


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """uid, doc_id, th, root (one uid of the group): groups of texts that similarity of at least `least` on shingles of `words` words links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text").to_pylist()
        sets = [shingle_hashes(t, words) for t in text]
        th = np.fromiter((xxhash.xxh64_intdigest(t, SPARK_SEED) for t in text), np.uint64, len(text))
        wide = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(th.view(np.int64)), pa.array([len(h) for h in sets], pa.int64()), pa.array(list(wide), pa.list_(pa.int64()))], ["doc_id", "th", "n", "w"])

    marked = by_batch(id_text(docs), run, "doc_id long, th long, n long, w array<bigint>")
    marked = written(marked.withColumn("uid", F.monotonically_increasing_id()), "similar")
    edges = written(similar_links(docs, marked, words, least, radius), "similar-links")
    if edges.isEmpty():
        return marked.select("uid", "doc_id", "th", F.col("uid").alias("root"))
    roots = components(edges).withColumnRenamed("v", "uid")
    return marked.join(roots, "uid", "left").select("uid", "doc_id", "th", F.coalesce("root", "uid").alias("root"))


def near_dedup(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (null last); all columns as they are."""
    with scratch(docs.sparkSession):
        groups = similar_groups(docs, words, least).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("k"))
        kept = written(first.groupBy("k.doc_id", "k.th").agg(F.sum("k.n").alias("n")), "simhash-kept", keep=True)
    return keep_rows(docs, kept)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
