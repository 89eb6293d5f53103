"""A query per operator on the tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.vectors import DISTANCES
from larkspur.operators import evaluate as ev
from larkspur.operators import indexing, matrix, minhash, patterns, relational, splits, topk
from larkspur.operators.joins import Target, cogroup, equi_join, lookup_join
from larkspur.plans import als, credit, walk
from larkspur.plans import reasons as why
from larkspur.plans import recommend as rec
from larkspur.session import shared_folder, written
from larkspur.sources import sinks
from larkspur.sources.delimited import as_lines, comma_fields, encode_fields, read_columns, read_lines, side_table
from larkspur.sources.options import read_places, targets
from larkspur.sources.tables import cells, ratings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUT = "1997-01-01"
RATINGS = "ratings AS (SELECT o_custkey AS \"user\", l_partkey AS item, sum(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
CELLS = "cells AS (SELECT o_custkey AS \"row\", l_partkey AS col, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
BRANDS = "brands AS (SELECT o_custkey AS \"row\", p_brand AS brand, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str, n: int = 6) -> F.Column:
    """Rounded, and without negative zero."""
    return (F.round(F.col(c), n) + 0.0).alias(c)


# ---- selection and filters


@query("SELECT o_custkey, o_orderkey, round(ln(o_totalprice + 1) + 1, 6) + 0.0 AS o_totalprice FROM orders")
def select_log(spark, d):
    return relational.select_columns(table(spark, d, "orders"), [1, 0, 3, 99], log=3).select("o_custkey", "o_orderkey", r("o_totalprice"))


@query("SELECT l_orderkey, l_partkey, round(ln(l_quantity + 1) + 1, 6) + 0.0 AS l_quantity FROM lineitem")
def log_last(spark, d):
    return relational.log_last(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")).select("l_orderkey", "l_partkey", r("l_quantity"))


@query("""
    WITH kept AS (
        SELECT user_id, event_type, event_id FROM events
        WHERE event_type NOT IN (SELECT min(event_type) FROM events) AND NOT (event_type LIKE 'R%' OR event_type LIKE 'H%'))
    SELECT user_id, event_type, event_id FROM kept WHERE user_id IN (SELECT user_id FROM kept GROUP BY 1 HAVING count(*) >= 3)""")
def filter_input(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return relational.filter_input(events, "user_id", "event_type", events.agg(F.min("event_type").alias("x")), least=3)


@query(f"WITH {CELLS} SELECT * FROM cells WHERE value >= 30")
def prune(spark, d):
    return relational.prune(cells(spark, d), 30)


def _uniform(seed: int, *columns: str) -> str:
    """splits.uniform(kind="arithmetic") in SQL."""
    x, p = f"{seed}::BIGINT", splits.PRIME
    for c in columns:
        x = f"(({x} * 48271 + {c} % {p}) % {p})"
        x = f"({x} * 1597334677 % {p})"
        x = f"((({x} * {x} + {x} * 69621 + 7) % {p}) * 742938285 % {p})"
    return f"({x} / {float(p)}::DOUBLE)"


@query(f"WITH {RATINGS} SELECT \"user\", item, rating FROM ratings WHERE {_uniform(17, chr(34) + 'user' + chr(34))} < 0.1 OR \"user\" IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 = 0)")
def sample_users(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return relational.sample_users(ratings(spark, d), "user", 0.1, users.where("user % 97 = 0"), kind="arithmetic")


@query("SELECT l_returnflag || ',' || l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1")
def text_encode_count(spark, d):
    lines = as_lines(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linestatus"))
    return lines.select(encode_fields(comma_fields(F.col("value")), [0, 2, 9]).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# ---- counts and sums


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def key_count(spark, d):
    return relational.key_count(table(spark, d, "events"), "event_type")


@query("""
    SELECT DISTINCT "column", value FROM (
        SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)""")
def distinct_columns(spark, d):
    return relational.distinct_columns(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", 99])


@query("SELECT count(*) AS n_rows, sum(l_quantity) AS l_quantity, sum(l_linenumber)::DOUBLE AS l_linenumber FROM lineitem")
def column_sums(spark, d):
    return relational.column_sums(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"])


@query(f"WITH {CELLS} SELECT \"row\", round(avg(value), 6) + 0.0 AS average FROM cells WHERE value <> 0 GROUP BY 1")
def row_mean(spark, d):
    return relational.row_average(cells(spark, d)).select("row", r("average"))


@query(f"WITH {CELLS} SELECT \"row\", count(*) AS n FROM cells WHERE value <> 0 GROUP BY 1")
def item_counts(spark, d):
    return relational.item_counts(cells(spark, d))


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1")
def max_per_key(spark, d):
    return matrix.max_per(table(spark, d, "orders"), "o_custkey", "o_totalprice")


_JACCARD = f"""
    WITH sides AS (
        SELECT o_custkey AS "user", l_partkey AS item, CASE WHEN o_orderdate < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    v AS (SELECT "user", item, count(*) AS n, min(t) AS lo, max(t) AS hi FROM sides GROUP BY 1, 2),
    found AS (SELECT "user", sum((%s)::INT)::BIGINT AS common, count(*) AS total FROM v GROUP BY 1 HAVING min(lo) = 0 AND max(hi) = 1)"""


def _halves(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp")
    return [x.where(early).drop("o_orderdate"), x.where(~early).drop("o_orderdate")]


@query(_JACCARD % "n > 1" + ' SELECT "user", common, total, round(common / total, 6) + 0.0 AS jaccard FROM found')
def jaccard(spark, d):
    return relational.jaccard(_halves(spark, d), "user", "item").select("user", "common", "total", r("jaccard"))


@query(_JACCARD % "lo <> hi" + ' SELECT "user", common, total, round(common / total, 6) + 0.0 AS jaccard FROM found')
def jaccard_strict(spark, d):
    return relational.jaccard(_halves(spark, d), "user", "item", strict=True).select("user", "common", "total", r("jaccard"))


@query(_JACCARD % "n > 1" + " SELECT count(*) AS n, round(avg(common / total), 6) + 0.0 AS mean FROM found")
def jaccard_stats(spark, d):
    return relational.jaccard_stats(relational.jaccard(_halves(spark, d), "user", "item")).select("n", r("mean"))


# ---- joins


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def _lookup(kind, small=False):
    def run(spark, d):
        c = table(spark, d, "customer").where("c_acctbal > 0")
        return lookup_join(_orders(spark, d), ["o_custkey"], [Target(c, ["c_custkey"], ["c_mktsegment", "c_name"], kind, ["o_orderstatus"])], small=small)

    return run


_GOOD = "good AS (SELECT c_custkey, c_mktsegment, c_name FROM customer WHERE c_acctbal > 0)"
for _name, _kind, _sql in (
    ("lookup_inner", "inner", f"WITH {_GOOD} SELECT o_orderkey, o_custkey, o_orderstatus, c_mktsegment, c_name FROM orders JOIN good ON o_custkey = c_custkey"),
    ("lookup_outer", "outer", f"WITH {_GOOD} SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(c_mktsegment, 'null') AS c_mktsegment, coalesce(c_name, 'null') AS c_name FROM orders LEFT JOIN good ON o_custkey = c_custkey"),
    ("lookup_filter", "filter", f"WITH {_GOOD} SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM good)"),
    ("lookup_sub", "sub", f"WITH {_GOOD} SELECT o_orderkey, o_custkey, c_mktsegment AS o_orderstatus FROM orders JOIN good ON o_custkey = c_custkey"),
):
    QUERIES[_name], ORACLES[_name] = _lookup(_kind), _sql
    QUERIES[f"{_name}_broadcast"], ORACLES[f"{_name}_broadcast"] = _lookup(_kind, True), _sql


@query("""
    WITH first AS (SELECT l_orderkey, min({'p': l_partkey, 's': l_suppkey}) AS v FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, o_orderstatus, v.p AS l_partkey, v.s AS l_suppkey FROM orders JOIN first ON o_orderkey = l_orderkey""")
def lookup_duplicates(spark, d):
    return lookup_join(_orders(spark, d), ["o_orderkey"], [Target(table(spark, d, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey"])])


@query("""
    SELECT n_nationkey, n_name, r_name, coalesce(s.s_name, 'null') AS s_name
    FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_nationkey < 12 GROUP BY 1) s ON s_nationkey = n_nationkey
    WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10)""")
def multi_target_lookup(spark, d):
    nation = table(spark, d, "nation").withColumns({"k": F.col("n_regionkey"), "k2": F.col("n_nationkey")})
    out = lookup_join(nation, ["k"], [Target(table(spark, d, "region"), ["r_regionkey"], ["r_name"])])
    out = lookup_join(out, ["k2"], [Target(table(spark, d, "supplier").where("s_nationkey < 12"), ["s_nationkey"], ["s_name"], "outer"), Target(table(spark, d, "customer").where("c_custkey < 10"), ["c_nationkey"], kind="filter")])
    return out.select("n_nationkey", "n_name", "r_name", "s_name")


def _equi(how):
    def run(spark, d):
        left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
        right = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey")
        return equi_join(left, right, ["k"], ["c_name"], ["o_orderkey"], how)

    return run


for _name, _how, _sql in (
    ("equi_inner", "inner", "SELECT c_custkey AS k, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'"),
    ("equi_left", "left", "SELECT c_custkey AS k, c_name, coalesce(o_orderkey, 0) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'"),
    ("equi_minus", "minus", "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
):
    QUERIES[_name], ORACLES[_name] = _equi(_how), _sql


@query(f"""
    WITH {RATINGS}, p AS (SELECT "user", count(*) AS n, sum(item)::BIGINT AS items, sum(rating) AS total FROM ratings GROUP BY 1)
    SELECT c_custkey AS "user", c_name AS v, true AS one_vector, coalesce(n, 0)::INT AS n, coalesce(items, 0)::BIGINT AS items, coalesce(total, 0.0) AS total
    FROM customer LEFT JOIN p ON "user" = c_custkey""")
def cogroup_prefs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("v"))
    out = cogroup(c, ratings(spark, d), "user", "v", "item", "rating")
    return out.select("user", "v", "one_vector", F.size("items").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, b: a + b).alias("items"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"SELECT o_orderkey, 0 AS part FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'")
def union_all(spark, d):
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp")
    return relational.union_all(o.where(early).select("o_orderkey"), o.where(~early).select("o_orderkey"), tag="part")


# ---- ids and dictionaries


@query("SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 + 100 AS id, c_custkey, c_name FROM customer")
def seq_ids(spark, d):
    return indexing.sequential_ids(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 100)


_BRAND = "dict AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part))"


@query(f"WITH {_BRAND} SELECT id, value FROM dict")
def dict_build(spark, d):
    return indexing.dictionary(table(spark, d, "part"), "p_brand")


@query(f"WITH {_BRAND}, types AS (SELECT p_type AS value, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, dict.id AS p_brand, types.id AS p_type FROM part JOIN dict ON p_brand = dict.value JOIN types ON p_type = types.value")
def dict_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return indexing.encode(part, {c: indexing.dictionary(part, c) for c in ("p_brand", "p_type")})


@query("""
    WITH old AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#3')),
    new AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 + (SELECT count(*) FROM old) AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT value FROM old)))
    SELECT id, value FROM old UNION ALL SELECT id, value FROM new""")
def dict_encode_incremental(spark, d):
    part = table(spark, d, "part")
    return indexing.dictionary(part, "p_brand", indexing.dictionary(part.where("p_brand < 'Brand#3'"), "p_brand"))


@query("SELECT p_partkey, p_brand FROM part")
def dict_decode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    own = {"p_brand": indexing.dictionary(part, "p_brand")}
    return indexing.decode(indexing.encode(part, own), own)


@query("SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS size FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part")
def dict_sizes(spark, d):
    part = table(spark, d, "part")
    return indexing.dictionary_sizes({c: indexing.dictionary(part, c) for c in ("p_brand", "p_type")})


# ---- matrices


@query(f"WITH {CELLS} SELECT * FROM cells WHERE value <> 0")
def row_vectors(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return matrix.from_table(x, "o_custkey", "l_partkey", "l_quantity")


@query(f"WITH {CELLS} SELECT \"row\", count(*)::INT AS n, sum(value) AS total FROM cells WHERE value <> 0 GROUP BY 1")
def row_vectors_compact(spark, d):
    rows = matrix.compact(cells(spark, d).where("value <> 0"))
    return rows.select("row", F.size("cells").alias("n"), F.aggregate(F.map_values("cells"), F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("SELECT o_custkey AS col, l_partkey AS \"row\", count(*)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def boolean_vectors(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return matrix.boolean(x.select(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")))


@query("SELECT l_orderkey AS \"row\", l_partkey AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) <> 0")
def vector_merge(spark, d):
    return matrix.vector_merge(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value")))


@query(f"WITH {CELLS} SELECT col AS \"row\", \"row\" AS col, value FROM cells")
def transpose(spark, d):
    return matrix.transpose(cells(spark, d))


@query(f"WITH {CELLS} SELECT \"row\", col, round(value / sum(value) OVER (PARTITION BY \"row\"), 6) + 0.0 AS value FROM cells")
def l1_norm(spark, d):
    return matrix.l1_normalise(cells(spark, d)).select("row", "col", r("value"))


@query(f"WITH {CELLS} SELECT \"row\" AS col, col AS \"row\", round(value / sqrt(sum(value * value) OVER (PARTITION BY \"row\")), 6) + 0.0 AS value FROM cells")
def l2_norm_reverse(spark, d):
    return matrix.l2_normalise(cells(spark, d), reverse=True).select("row", "col", r("value"))


@query(f"WITH {CELLS} SELECT \"row\", col, round(value / sqrt(sum(value * value) OVER (PARTITION BY \"row\")), 6) + 0.0 AS value FROM cells")
def l2_norm(spark, d):
    return matrix.l2_normalise(cells(spark, d)).select("row", "col", r("value"))


def _brand_rows(spark, d):
    """Brands by users."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    coded = indexing.encode(part, {"p_brand": indexing.dictionary(part, "p_brand")})
    x = ratings(spark, d).join(coded, F.col("item") == F.col("p_partkey"))
    return x.groupBy(F.col("p_brand").alias("row"), F.col("user").alias("col")).agg(F.sum("rating").alias("value"))


_SELF = f"WITH {CELLS}, p AS (SELECT x.col AS \"row\", y.col AS col, sum(x.value * y.value) AS value FROM cells x JOIN cells y ON x.\"row\" = y.\"row\" GROUP BY 1, 2) "


@query(_SELF + "SELECT * FROM p WHERE value >= 1000")
def atb_threshold(spark, d):
    """Items by items."""
    x = cells(spark, d)
    return matrix.atb(x, x, 1000)


@query(_SELF + "SELECT * FROM p WHERE value <> 0")
def gram(spark, d):
    return matrix.gram(cells(spark, d))


@query(f"WITH {BRANDS}, {_BRAND}, b AS (SELECT id AS i, \"row\" AS u, brands.value AS x FROM brands JOIN dict ON brand = dict.value), {CELLS} SELECT b.i AS \"row\", c.col, ceil(sum(b.x * c.value))::BIGINT AS value FROM b JOIN cells c ON b.u = c.\"row\" GROUP BY 1, 2")
def block_multiply(spark, d):
    """Brands by users times users by items: many blocks in both."""
    return matrix.multiply(_brand_rows(spark, d), cells(spark, d), as_int=True)


@query(_SELF + "SELECT * FROM p WHERE value > 1000")
def cell_multiply(spark, d):
    x = cells(spark, d)
    return matrix.multiply(matrix.transpose(x), x, threshold=1000, strategy=4)


_HALF = "SELECT o_custkey AS \"row\", l_partkey AS col, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate {} TIMESTAMP '" + CUT + "' GROUP BY 1, 2"
_DIST = f"WITH a AS ({_HALF.format('<')}), b AS ({_HALF.format('>=')}), diff AS (SELECT coalesce(a.\"row\", b.\"row\") AS \"row\", coalesce(a.value, 0) - coalesce(b.value, 0) AS x FROM a FULL JOIN b ON a.\"row\" = b.\"row\" AND a.col = b.col), dist AS (SELECT \"row\", sum(x * x) AS distance FROM diff GROUP BY 1) "


def _distances(spark, d):
    a, b = (x.select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value")) for x in (ratings(spark, d, before=CUT), ratings(spark, d, since=CUT)))
    return matrix.distance_squared(a, b)


@query(_DIST + "SELECT * FROM dist")
def dist_sq(spark, d):
    return _distances(spark, d)


@query(_DIST + "SELECT count(*) AS n_rows, sum(distance) AS distance FROM dist")
def dist_sq_total(spark, d):
    return matrix.distance_total(_distances(spark, d))


_AXIS = [round(float(np.cos(i)), 3) for i in range(64)]
_VECS = f"v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest([{', '.join(map(str, _AXIS))}])::DOUBLE AS y FROM embeddings), s AS (SELECT vec_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum((x - y) * (x - y)) AS sq, sum(abs(x - y)) AS mh FROM v GROUP BY 1)"
_MEASURES = {"cosine": "1 - xy / (sqrt(xx) * sqrt(yy))", "euclidean": "sqrt(sq)", "squared_euclidean": "sq", "manhattan": "mh", "tanimoto": "1 - xy / (xx + yy - xy)"}


def _measure(name):
    return lambda spark, d: matrix.row_vector_distance(table(spark, d, "embeddings"), _AXIS, "vec_id", "embedding", name).select("vec_id", r("distance", 5))


for _name in DISTANCES:
    QUERIES[f"row_vector_{_name}"] = _measure(_name)
    ORACLES[f"row_vector_{_name}"] = f"WITH {_VECS} SELECT vec_id, round({_MEASURES[_name]}, 5) + 0.0 AS distance FROM s"


@query(f"""
    WITH {CELLS}, m AS (SELECT col, avg(value) AS mean FROM cells WHERE value <> 0 GROUP BY 1), l AS (SELECT sqrt(sum(mean * mean)) AS len FROM m)
    SELECT "row", round(1 - sum(value * mean) / (sqrt(sum(value * value)) * max(len)), 6) + 0.0 AS distance FROM cells JOIN m USING (col), l GROUP BY 1""")
def user_credit(spark, d):
    return credit.user_credit(cells(spark, d)).select("row", r("distance"))


@query(f"""
    WITH {CELLS}, n AS (SELECT a.col, b.col AS other, count(*) AS n FROM cells a JOIN cells b ON a."row" = b."row" AND a.col <> b.col GROUP BY 1, 2)
    SELECT col, other, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, other) AS rank FROM n) WHERE rank <= 5""")
def cooccurrence_topk(spark, d):
    return matrix.cooccurrence_topk(cells(spark, d), 5)


@query("SELECT range AS \"row\", range AS col, 1.0::DOUBLE AS value FROM range(100)")
def identity_matrix(spark, d):
    return matrix.identity(spark, 100)


@query(f"WITH {CELLS} SELECT * FROM cells WHERE \"row\" = (SELECT min(\"row\") FROM cells)")
def first_row(spark, d):
    return matrix.first_row(cells(spark, d))


@query(f"WITH {CELLS} SELECT \"row\"::VARCHAR || chr(9) || string_agg(chr(9) || col || ':' || value::DECIMAL(18,1), '' ORDER BY col) AS value FROM cells GROUP BY \"row\"")
def matrix_text(spark, d):
    return matrix.to_text(cells(spark, d))


@query(f"WITH {CELLS} SELECT \"row\" || ',' || col || ',' || value::DECIMAL(18,1) AS value FROM cells")
def matrix_text_raw(spark, d):
    return matrix.to_text(cells(spark, d), "raw")


# ---- rankings


_TOP = f"WITH {RATINGS}, top AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY rating DESC, item) AS rank FROM ratings) "


@query(_TOP + "SELECT \"user\", item, rating, rank::INT AS rank FROM top WHERE rank <= 5")
def topk_rows(spark, d):
    return topk.topk_rows(ratings(spark, d), 5, "user", "item", "rating")


@query(_TOP + "SELECT \"user\", string_agg(item || ',' || rating::DECIMAL(18,1), ',' ORDER BY rank) AS record FROM top WHERE rank <= 5 GROUP BY 1")
def topk_wide(spark, d):
    return topk.wide_text(topk.topk_wide(ratings(spark, d), 5, "user", "item", "rating"), "user", "item", "rating")


@query(f"WITH {RATINGS}, m AS (SELECT *, min(rating) OVER w AS lo, max(rating) OVER w AS hi FROM ratings WINDOW w AS (PARTITION BY \"user\")) SELECT \"user\", item, round(least(CASE WHEN lo = hi THEN rating ELSE (rating - lo) / (hi - lo) * 0.5 + 0.5 END, 5.0), 6) + 0.0 AS rating FROM m")
def minmax_scores(spark, d):
    return topk.minmax_scores(ratings(spark, d), 5.0, "user", "rating").select("user", "item", r("rating"))


# ---- splits


@query(f"WITH {RATINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY item) - 1 AS i, ceil(count(*) OVER (PARTITION BY \"user\") / 4) AS w FROM ratings) SELECT \"user\", item, rating, floor(i / w)::INT AS fold FROM n")
def kfold_ordered(spark, d):
    return splits.kfold(ratings(spark, d), "user", 4, F.col("item"))


_Q = chr(34) + "user" + chr(34)


@query(f"WITH {RATINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY {_uniform(11, _Q, 'item')}, item) - 1 AS i, ceil(count(*) OVER (PARTITION BY \"user\") / 4) AS w FROM ratings) SELECT \"user\", item, rating, floor(i / w)::INT AS fold FROM n")
def kfold(spark, d):
    return splits.kfold(ratings(spark, d), "user", 4, [splits.uniform("user", "item", kind="arithmetic"), F.col("item")])


@query(f"WITH {RATINGS}, n AS (SELECT *, {_uniform(11, _Q, 'item')} AS u FROM ratings) SELECT \"user\", item, rating, CASE WHEN u <= 0.8 THEN 0 ELSE 1 END AS side FROM n WHERE u <= 0.8 + 0.15")
def random_split(spark, d):
    train, probe = splits.random_split(ratings(spark, d), 0.8, 0.15, by=["user", "item"], kind="arithmetic")
    return relational.union_all(train, probe, tag="side")


# ---- evaluation


_LISTS = f"""
    WITH train AS ({_HALF.format('<')}), probe AS ({_HALF.format('>=')}),
    counts AS (SELECT "row", count(*) AS item_count FROM probe GROUP BY 1),
    recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY value DESC, col) AS k FROM train) WHERE k <= 30),
    lists AS (
        SELECT r."row", r.col, r.k AS rank, c.item_count, coalesce(p.value, -1.0) AS flag, count(*) OVER (PARTITION BY r."row") AS n
        FROM recs r JOIN counts c ON r."row" = c."row" LEFT JOIN probe p ON p."row" = r."row" AND p.col = r.col),
    h AS (SELECT *, (flag > -1)::INT AS hit, sum((flag > -1)::INT) OVER (PARTITION BY "row" ORDER BY rank) AS so_far FROM lists),
    e AS (
        SELECT "row" AS "user", max(item_count) AS item_count, sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END)::BIGINT AS hits,
            sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END) / 20 AS "precision",
            sum(CASE WHEN rank <= 20 AND hit = 1 THEN so_far / rank ELSE 0.0 END) / least(max(item_count), 20) AS map,
            CASE WHEN sum(CASE WHEN rank <= 20 THEN flag ELSE 0 END) < 1e-5 THEN 0.0 ELSE
                sum(CASE WHEN rank <= 20 THEN flag * CASE WHEN rank = least(20, n) THEN 100.0 ELSE 100.0 * (rank - 1) / n END ELSE 0 END) / sum(CASE WHEN rank <= 20 THEN flag ELSE 0 END) END AS epr,
            {', '.join(f"CASE WHEN max(n) >= {2 * i} THEN sum(CASE WHEN rank <= {2 * i} THEN hit ELSE 0 END) / max(item_count) END AS recall_{i}" for i in range(1, 11))}
        FROM h GROUP BY 1) """
_MEANS = ["precision", "map", "epr", *(f"recall_{i}" for i in range(1, 11))]


def _evaluated(spark, d):
    recs = topk.topk_rows(ratings(spark, d, before=CUT), 30, "user", "item", "rating").select("user", "item", F.col("rating").alias("score"))
    return ev.recommend_evaluate(recs, ratings(spark, d, since=CUT), 20)


@query(_LISTS + 'SELECT "user", item_count, hits, ' + ", ".join(f'round("{m}", 6) + 0.0 AS "{m}"' for m in _MEANS) + " FROM e")
def eval_users(spark, d):
    return _evaluated(spark, d).select("user", "item_count", "hits", *[r(m) for m in _MEANS])


@query(_LISTS + "SELECT count(*) AS n_users, sum(item_count)::BIGINT AS item_count, sum(hits)::BIGINT AS hits, " + ", ".join(f'round(avg("{m}"), 5) + 0.0 AS "{m}"' for m in _MEANS) + " FROM e")
def eval_stats(spark, d):
    return ev.stats(_evaluated(spark, d)).select("n_users", "item_count", "hits", *[r(m, 5) for m in _MEANS])


# ---- walks


_W0 = f"""{CELLS}, v AS (SELECT "row" AS u, col AS i, value / sum(value) OVER (PARTITION BY "row") AS x FROM cells),
    w AS (SELECT "row" AS u, col AS i, value / sum(value) OVER (PARTITION BY col) AS x FROM cells),
    c0 AS (SELECT p_partkey AS i, substr(p_brand, 7, 1)::BIGINT AS c, 1.0 AS x FROM part)"""


def _step(n: int) -> str:
    return f""", u{n} AS (SELECT v.u, c.c, sum(v.x * c.x) AS x FROM v JOIN c{n - 1} c ON v.i = c.i GROUP BY 1, 2 HAVING sum(v.x * c.x) >= 1e-8),
    c{n} AS (SELECT w.i, u.c, sum(w.x * u.x) AS x FROM w JOIN u{n} u ON w.u = u.u GROUP BY 1, 2 HAVING sum(w.x * u.x) >= 1e-8)"""


def _walked(spark, d, n):
    part = table(spark, d, "part")
    edges = ratings(spark, d).withColumnRenamed("rating", "weight")
    classes = part.select(F.col("p_partkey").alias("item"), F.substring("p_brand", 7, 1).cast("long").alias("class"))
    return edges, *walk.random_walk(edges, n, classes=classes)


@query(f"WITH {_W0}{_step(1)} SELECT u AS \"row\", c AS col, round(x, 9) + 0.0 AS value FROM u1")
def random_walk_1iter(spark, d):
    return _walked(spark, d, 1)[1].select("row", "col", r("value", 9))


@query(f"WITH {_W0}{_step(1)}{_step(2)} SELECT i AS \"row\", c AS col, round(x, 9) + 0.0 AS value FROM c2")
def random_walk_2iter(spark, d):
    return _walked(spark, d, 2)[2].select("row", "col", r("value", 9))


@query(f"""
    WITH {_W0}{_step(1)}, e AS (SELECT "row" AS u, col AS i, min(value) AS edge FROM cells GROUP BY 1, 2),
    a AS (SELECT u, c, row_number() OVER (PARTITION BY u ORDER BY round(x, 9) DESC, c) AS rank FROM u1),
    b AS (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY round(x, 9) DESC, i) AS rank FROM c1)
    SELECT a.u AS "row", a.c AS col, rank::INT AS rank, coalesce(edge, -1.0) AS edge, 'user' AS side FROM a LEFT JOIN e ON a.u = e.u AND a.c = e.i WHERE rank <= 3
    UNION ALL SELECT c, i, rank::INT, NULL, 'class' FROM b WHERE rank <= 3""")
def random_walk_lists(spark, d):
    edges, users, items = _walked(spark, d, 1)
    best, inverse = walk.walk_lists(edges, users.select("row", "col", r("value", 9)), items.select("row", "col", r("value", 9)), 3)
    return best.select("row", "col", "rank", "edge", F.lit("user").alias("side")).unionByName(inverse.select("row", "col", "rank", F.lit(None).cast("double").alias("edge"), F.lit("class").alias("side")))


# ---- clusters and patterns


_P = minhash.PRIME


@query(f"""
    WITH x AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem),
    f AS (SELECT range AS i, range * 1103515245 % {_P} + 1 AS a, (range * 12345 + 7) * 2654435 % {_P} AS b FROM range(6)),
    h AS (SELECT id, i, min((a * (e % {_P}) + b) % {_P}) AS m FROM x, f GROUP BY 1, 2),
    c AS (SELECT DISTINCT p.id, p.m || '-' || q.m AS cluster FROM h p JOIN h q ON p.id = q.id AND q.i = (p.i + 1) % 6)
    SELECT cluster, id FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY 1 HAVING count(*) >= 2)""")
def minhash_clusters(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("e"))
    return minhash.minhash_clusters(lines, "id", "e", hashes=6, group=2, min_cluster=2)


_BASKETS = "x AS (SELECT DISTINCT l_orderkey AS id, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark, d):
    """The brands of each order."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))


@query(f"WITH {_BASKETS} SELECT i AS item, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 5")
def frequent_items(spark, d):
    return patterns.frequent_items(_baskets(spark, d), 5)


@query(f"""
    WITH {_BASKETS},
    s2 AS (SELECT a.id, a.i AS a, b.i AS b FROM x a JOIN x b ON a.id = b.id AND a.i < b.i),
    s3 AS (SELECT s2.id, a, b, c.i AS c FROM s2 JOIN x c ON s2.id = c.id AND b < c.i),
    s4 AS (SELECT s3.id, a, b, c, e.i AS e FROM s3 JOIN x e ON s3.id = e.id AND c < e.i),
    p AS (
        SELECT [i] AS items, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT [a, b], count(*) FROM s2 GROUP BY 1
        UNION ALL SELECT [a, b, c], count(*) FROM s3 GROUP BY 1 UNION ALL SELECT [a, b, c, e], count(*) FROM s4 GROUP BY 1),
    each AS (SELECT unnest(items) AS item, array_to_string(items, ',') AS pattern, len(items) AS len, n FROM p WHERE n >= 5)
    SELECT item, pattern, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, len DESC, pattern) AS rank FROM each) WHERE rank <= 50""")
def fp_growth_topk(spark, d):
    """All patterns are mined; the SQL stops at sets of four, as no larger one is among an item's first 50 (tests look at all sizes on small baskets)."""
    return patterns.top_patterns(_baskets(spark, d), 5, 50).withColumn("pattern", F.array_join("pattern", ","))


@query(f"WITH {_BASKETS} SELECT a.i AS a, b.i AS b, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 5")
def pair_supports(spark, d):
    return patterns.pair_supports(_baskets(spark, d).select("l_orderkey", F.explode("items").alias("i")), "l_orderkey", "i", 5)


# ---- factorisation


def _factors(spark, d, implicit):
    return als.factorise(ratings(spark, d), 8, 2, 0.065, implicit, alpha=1.0)


@query()
def als_explicit(spark, d):
    return _factors(spark, d, False)[0]


@query()
def als_implicit(spark, d):
    return _factors(spark, d, True)[0]


@query()
def als_implicit_join(spark, d):
    return als.factorise(ratings(spark, d), 4, 1, 0.065, True, alpha=1.0, strategy="join")[0]


@query()
def recommend(spark, d):
    own = written(ratings(spark, d), "ratings")
    users, items, _ = als.factorise(own, 8, 2, 0.065, True, alpha=1.0)
    return rec.recommend(users, items, own, 10)


#: Factors that SQL can write down, for half-steps and scores with two features.
_ITEM_F = "y AS (SELECT p_partkey AS id, 1.0 + p_partkey % 7 / 10 AS a, p_partkey % 11 / 10 - 0.3 AS b FROM part)"


def _item_factors(spark, d):
    f = F.array(F.lit(1.0) + F.col("p_partkey") % 7 / 10, F.col("p_partkey") % 11 / 10 - F.lit(0.3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), f.cast("array<double>").alias("f"))


def _solved(m: str) -> str:
    """A 2 x 2 system with p, q, q, s and right side u, v, by its determinant."""
    return f"SELECT id, round((s * u - q * v) / (p * s - q * q), 6) + 0.0 AS f0, round((p * v - q * u) / (p * s - q * q), 6) + 0.0 AS f1 FROM ({m})"


def _two(solved: DataFrame) -> DataFrame:
    return solved.select("id", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")).select("id", r("f0"), r("f1"))


_SUMS = 'SELECT "user" AS id, sum({w} * a * a) AS p, sum({w} * a * b) AS q, sum({w} * b * b) AS s, sum({t} * a) AS u, sum({t} * b) AS v, count(*) AS n FROM ratings JOIN y ON item = y.id GROUP BY 1'


@query(f"WITH {RATINGS}, {_ITEM_F}, m AS ({_SUMS.format(w='1.0', t='rating')}) " + _solved("SELECT id, p + 0.065 * n AS p, q, s + 0.065 * n AS s, u, v FROM m"))
def als_half_step_explicit(spark, d):
    return _two(als.half_step(ratings(spark, d), _item_factors(spark, d), "user", "item", 2, 0.065))


_IMPLICIT = f"WITH {RATINGS}, {_ITEM_F}, g AS (SELECT sum(a * a) AS gp, sum(a * b) AS gq, sum(b * b) AS gs FROM y), m AS ({_SUMS.format(w='1.5 * rating', t='(1 + 1.5 * rating)')}) " + _solved("SELECT id, p + gp + 0.1 AS p, q + gq AS q, s + gs + 0.1 AS s, u, v FROM m, g")


def _implicit_step(strategy):
    return lambda spark, d: _two(als.half_step(ratings(spark, d), _item_factors(spark, d), "user", "item", 2, 0.1, 1.5, True, strategy))


QUERIES["als_half_step_implicit"], ORACLES["als_half_step_implicit"] = _implicit_step("broadcast"), _IMPLICIT
QUERIES["als_half_step_implicit_join"], ORACLES["als_half_step_implicit_join"] = _implicit_step("join"), _IMPLICIT

_WHOLE_F = """x AS (SELECT c_custkey AS id, c_custkey * 7919 % 101 - 50 AS a, c_custkey * 104729 % 103 - 40 AS b FROM customer),
    y AS (SELECT p_partkey AS id, p_partkey * 7907 % 97 - 30 AS a, p_partkey * 104711 % 89 - 50 AS b FROM part)"""


def _whole_factors(spark, d, name, key, *terms):
    f = F.array(*[((F.col(key) * a) % m - minus).cast("double") for a, m, minus in terms])
    return table(spark, d, name).select(F.col(key).alias("id"), f.alias("f"))


@query(f"""
    WITH {RATINGS}, {_WHOLE_F}, n AS (SELECT "user", count(*) AS n FROM ratings GROUP BY 1),
    top AS (SELECT x.id AS "user", y.id AS item, (x.a * y.a + x.b * y.b)::DOUBLE AS score, row_number() OVER (PARTITION BY x.id ORDER BY x.a * y.a + x.b * y.b DESC, y.id) AS k FROM x, y),
    l AS (SELECT top."user", item, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM top LEFT JOIN n ON top."user" = n."user" WHERE k <= 10 + coalesce(n, 0) WINDOW w AS (PARTITION BY top."user")),
    fresh AS (SELECT "user", item, CASE WHEN lo = hi THEN score ELSE (score - lo) / (hi - lo) * 0.5 + 0.5 END AS score FROM l WHERE ("user", item) NOT IN (SELECT "user", item FROM ratings)),
    r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM fresh)
    SELECT "user", item, round(score, 6) + 0.0 AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def recommend_given_factors(spark, d):
    users = _whole_factors(spark, d, "customer", "c_custkey", (7919, 101, 50), (104729, 103, 40))
    items = _whole_factors(spark, d, "part", "p_partkey", (7907, 97, 30), (104711, 89, 50))
    return rec.recommend(users, items, ratings(spark, d), 10).select("user", "item", r("score"), "rank")


@query(f"""
    WITH {RATINGS}, {_ITEM_F}, g AS (SELECT sum(a * a) AS gp, sum(a * b) AS gq, sum(b * b) AS gs FROM y),
    m AS (SELECT "user", sum(1.5 * rating * a * a) + max(gp) + 0.1 AS p, sum(1.5 * rating * a * b) + max(gq) AS q, sum(1.5 * rating * b * b) + max(gs) + 0.1 AS s FROM ratings JOIN y ON item = y.id, g GROUP BY 1),
    recs AS (SELECT "user", max(item) + 1 AS item FROM ratings GROUP BY 1),
    pts AS (SELECT recs."user", recs.item, t.item AS other, round((o.a * (s * z.a - q * z.b) + o.b * (p * z.b - q * z.a)) / (p * s - q * q), 12) AS points
        FROM recs JOIN y z ON z.id = recs.item JOIN m ON m."user" = recs."user" JOIN ratings t ON t."user" = recs."user" JOIN y o ON o.id = t.item)
    SELECT "user", item, CASE WHEN points > 0 THEN other ELSE -1 END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY points DESC, other) AS k FROM pts) WHERE k = 1""")
def als_reasons(spark, d):
    own, items = ratings(spark, d), _item_factors(spark, d)
    recs = own.groupBy("user").agg((F.max("item") + 1).alias("item"))
    return why.als_reasons(recs, own, items, als.gram(items, 2), 0.1, 1.5)


@query(f"""
    WITH {_BRAND}, names AS (SELECT value, id FROM dict)
    SELECT a.id AS item, b.id AS other, n / 1000 AS similarity FROM (
        SELECT p_brand AS x, 'Brand#' || (5 - p_size % 5) || (1 + p_size % 5) AS z, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2)
    JOIN names a ON a.value = x JOIN names b ON b.value = z""")
def association_similarity(spark, d):
    """Rules by brand names to rules by brand ids."""
    part = table(spark, d, "part")
    other = F.concat(F.lit("Brand#"), (5 - F.col("p_size") % 5).cast("string"), (1 + F.col("p_size") % 5).cast("string"))
    rules = part.groupBy(F.col("p_brand").alias("item"), other.alias("other")).agg((F.count(F.lit(1)) / 1000).alias("similarity"))
    return why.association_similarity(rules, indexing.dictionary(part, "p_brand"))


# ---- text, sorted tables and stores


def _folder(spark, name):
    return f"{shared_folder(spark)}/larkspur/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def text_scan(spark, d):
    """A table written as lines and read back as typed columns."""
    path = _folder(spark, "lines")
    sinks.write_text(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), path)
    return read_columns(spark, path, {"l_orderkey": "long", "l_partkey": "long", "l_quantity": "double"})


@query("SELECT 'orders' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'parts', p_partkey FROM part")
def text_union_scan(spark, d):
    """Several paths of lines, told apart by a tag."""
    paths = [_folder(spark, "lines") for _ in range(2)]
    sinks.write_text(table(spark, d, "orders").select("o_orderkey"), paths[0])
    sinks.write_text(table(spark, d, "part").select("p_partkey"), paths[1])
    return read_lines(spark, *paths, tag="t").select(F.when(F.col("t") == 0, "orders").otherwise("parts").alias("kind"), F.col("value").cast("long").alias("id"))


@query("SELECT c_custkey::VARCHAR AS key, c_mktsegment || ',' || c_nationkey AS value FROM customer")
def side_table_load(spark, d):
    path = _folder(spark, "lines")
    sinks.write_text(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), path)
    return side_table(spark, path, [1], [2, 0])


@query(f"WITH {_GOOD} SELECT o_orderkey::VARCHAR AS c0, c_mktsegment AS c1, o_orderstatus AS c2, coalesce(n_name, 'null') AS v1_1 FROM orders JOIN good ON o_custkey = c_custkey LEFT JOIN nation ON o_orderkey % 40 = n_nationkey")
def targets_from_text(spark, d):
    """Both targets of a lookup written as lines and named in one line of options."""
    a, b, source = (_folder(spark, "lines") for _ in range(3))
    sinks.write_text(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), a)
    sinks.write_text(table(spark, d, "nation").select("n_nationkey", "n_name"), b)
    sinks.write_text(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey") % 40), source)
    first, second = targets(spark, f"{a}:1:0:1:sub::{b}::0:1:outer")
    out = lookup_join(read_places(spark, source, 4), ["c1"], [first])
    return lookup_join(out, ["c3"], [second]).drop("c3")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 64, 100, 5000, -7)")
def sorted_lookup(spark, d):
    path = _folder(spark, "sorted")
    sinks.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", path)
    return sinks.lookup(spark, path, "o_orderkey", [1, 2, 3, 64, 100, 5000, -7])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def folders_by_value(spark, d):
    path = _folder(spark, "values")
    sinks.write_by_value(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", path)
    return spark.read.parquet(path).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("SELECT n_nationkey AS \"row\", n_regionkey AS col, 1.0 + n_nationkey AS value FROM nation")
def dense_matrix(spark, d):
    """A small matrix to the driver and back."""
    own = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_regionkey").cast("long").alias("col"), (F.lit(1.0) + F.col("n_nationkey")).alias("value"))
    return matrix.from_dense(spark, matrix.dense(own, 25, 5)).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


_SIMILAR = 5


@query(f"""
    WITH {RATINGS}, top AS (SELECT "user", item, rating FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS rank FROM ratings) WHERE rank <= 12),
    recs AS (SELECT "user", item, score FROM (SELECT "user", item + 1 AS item, rating AS score, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS k FROM top) WHERE k <= 3),
    sim AS (SELECT p_partkey AS item, p_partkey + 2 AS other, 0.25 AS similarity FROM part),
    pts AS (
        SELECT r."user", r.item, r.score, t.item AS other, coalesce(1.0 + s.similarity, 0.0) + coalesce(CASE WHEN length(a.p_type) > 0 THEN (
            SELECT count(*) FROM range(1, 1 + least(length(a.p_type), length(b.p_type))) g WHERE starts_with(b.p_type, substr(a.p_type, 1, g.range::INT))) / length(a.p_type) ELSE 0.0 END, 0.0) AS points
        FROM recs r JOIN top t ON r."user" = t."user" LEFT JOIN sim s ON s.item = r.item AND s.other = t.item
        LEFT JOIN part a ON a.p_partkey = r.item LEFT JOIN part b ON b.p_partkey = t.item)
    SELECT "user", item, score, other AS reason, CASE WHEN points >= 1 THEN 'SIMILARITY' WHEN points > 0 THEN 'CATEGORY' ELSE 'RANDOM' END AS kind
    FROM (SELECT *, row_number() OVER (PARTITION BY "user", item, score ORDER BY points DESC, other) AS k FROM pts) WHERE k = 1""")
def prefix_reason(spark, d):
    top = topk.topk_rows(ratings(spark, d), 12, "user", "item", "rating")
    recs = top.where("rank <= 3").select("user", (F.col("item") + 1).alias("item"), F.col("rating").alias("score"))
    part = table(spark, d, "part")
    similar = part.select(F.col("p_partkey").alias("item"), (F.col("p_partkey") + 2).alias("other"), F.lit(0.25).alias("similarity"))
    return why.reasons(recs, top, similar, part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category")))


@query(f"""
    WITH {RATINGS}, top AS (SELECT "user", item, rating, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS rank FROM ratings),
    big AS (SELECT o_custkey AS "user", l_partkey AS item, min(l_orderkey) AS l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 GROUP BY 1, 2)
    SELECT top."user", top.item, rating, rank::INT AS rank, coalesce(l_orderkey, -1) AS large_order FROM top LEFT JOIN big ON top."user" = big."user" AND top.item = big.item WHERE rank <= 5""")
def flagship(spark, d):
    """The five parts a customer bought most, each with the first order of 45 or more of it, if any."""
    top = topk.topk_rows(ratings(spark, d), 5, "user", "item", "rating")
    big = table(spark, d, "lineitem").where("l_quantity >= 45").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lookup_join(top, ["user", "item"], [Target(big, ["o_custkey", "l_partkey"], ["l_orderkey"], "outer", names=["large_order"])], default=-1)
