"""The queries that cover the engine's operators, each with equivalent SQL where there is any."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import epoch_offset, grams
from .model import STAR, ForeignKey, Schema, TableSpec
from .operators import aggregates, bayes, estimators, exact, prepare, statistics
from .plans import bound, planner
from .plans.parser import parse_aggregate, parse_one
from .plans.query import Query
from .streaming import incremental

Run = Callable[[SparkSession, str], DataFrame]
MADE: dict[str, Run] = {}
SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, names: Collection[str] = STAR.tables) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in STAR.tables if n in names}


def query(name: str, sql: str | None = None):
    def keep(f: Run) -> Run:
        MADE[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def long(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# --- scans

for _t, _spec in STAR.tables.items():
    _c = _spec.join_columns[0]
    query(f"scan_{_t}", f"SELECT count(*)::BIGINT AS n_rows, count(DISTINCT {_c})::BIGINT AS n_keys, sum({_c})::BIGINT AS key_sum FROM {_t}")(
        lambda spark, d, t=_t, c=_c: tables(spark, d)[t].agg(long(F.count("*"), "n_rows"), long(F.count_distinct(c), "n_keys"), long(F.sum(c), "key_sum"))
    )

# --- degrees

for _t, _c in (("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("customer", "c_nationkey"), ("events", "user_id")):
    _deg = f"(SELECT {_c}::BIGINT AS key, count(*)::BIGINT AS d FROM {_t} WHERE {_c} IS NOT NULL GROUP BY {_c})"
    query(f"degree_sequence_{_t}_{_c}", f"SELECT * FROM {_deg}")(lambda spark, d, t=_t, c=_c: exact.degrees(tables(spark, d)[t], c).select(long("key", "key"), "d"))
    query(f"degree_rle_{_t}_{_c}", f"SELECT d, count(*)::BIGINT AS n FROM {_deg} GROUP BY d")(lambda spark, d, t=_t, c=_c: exact.degree_runs(tables(spark, d)[t], c))
    query(f"max_frequency_{_t}_{_c}", f"SELECT max(d) AS max_frequency FROM {_deg}")(lambda spark, d, t=_t, c=_c: exact.max_frequency(tables(spark, d)[t], c))
    query(f"self_join_size_{_t}_{_c}", f"SELECT sum(d * d)::BIGINT AS self_join_size FROM {_deg}")(lambda spark, d, t=_t, c=_c: exact.self_join_size(tables(spark, d)[t], c))

query(
    "cumulative_degrees",
    "SELECT d, n, (sum(n) OVER w - n + 1)::BIGINT AS first, (sum(n) OVER w)::BIGINT AS last, (sum(d * n) OVER w)::BIGINT AS rows FROM (SELECT d, count(*)::BIGINT AS n FROM (SELECT count(*)::BIGINT AS d FROM lineitem GROUP BY l_partkey) GROUP BY d) WINDOW w AS (ORDER BY d DESC)",
)(lambda spark, d: exact.ranked_degrees(tables(spark, d)["lineitem"], "l_partkey"))

query("filtered_degree_sequence", "SELECT o_custkey AS key, count(*)::BIGINT AS d FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL GROUP BY o_custkey")(
    lambda spark, d: exact.degrees(exact.alias_rows(tables(spark, d), parse_one("SELECT * FROM orders AS o WHERE o.o_orderpriority = '1-URGENT'"), "o"), "o__o_custkey")
)

# --- predicates and joins, from SQL by our own reader

PREDICATES = {
    "eq": "SELECT * FROM part AS p WHERE p.p_brand = 'Brand#11'",
    "eq_number": "SELECT * FROM part AS p WHERE p.p_size = 15",
    "ne": "SELECT * FROM orders AS o WHERE o.o_orderstatus != 'F'",
    "lt": "SELECT * FROM lineitem AS l WHERE l.l_quantity < 10",
    "le": "SELECT * FROM lineitem AS l WHERE l.l_quantity <= 10",
    "gt": "SELECT * FROM lineitem AS l WHERE l.l_discount > 0.05",
    "ge": "SELECT * FROM orders AS o WHERE o.o_totalprice >= 100000.0",
    "range_date": "SELECT * FROM orders AS o WHERE o.o_orderdate >= '1995-01-01'::timestamp AND o.o_orderdate < '1996-01-01'::timestamp",
    "between": "SELECT * FROM part AS p WHERE p.p_size BETWEEN 10 AND 20",
    "in": "SELECT * FROM orders AS o WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH', 'absent', '2-HIGH')",
    "not_in": "SELECT * FROM orders AS o WHERE o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "in_query": "SELECT * FROM orders AS o WHERE o.o_custkey IN (SELECT c.c_custkey FROM customer AS c WHERE c.c_acctbal < 0)",
    "like": "SELECT * FROM part AS p WHERE p.p_name LIKE '%red%'",
    "like_short": "SELECT * FROM part AS p WHERE p.p_name LIKE '%e_'",
    "not_like": "SELECT * FROM part AS p WHERE p.p_name NOT LIKE '%red%'",
    "is_null": "SELECT * FROM customer AS c WHERE c.c_name IS NULL",
    "is_not_null": "SELECT * FROM customer AS c WHERE c.c_name IS NOT NULL",
    "or": "SELECT * FROM part AS p WHERE (p.p_size < 5 OR p.p_size > 45) AND p.p_retailprice > 1000",
    "contradiction": "SELECT * FROM part AS p WHERE p.p_size > 5 AND p.p_size < 3",
    "string_range": "SELECT * FROM part AS p WHERE p.p_type >= 'M' AND p.p_type < 'S'",
}
JOINS = {
    "two_tables": "SELECT * FROM supplier AS s, customer AS c WHERE s.s_nationkey = c.c_nationkey",
    "chain": "SELECT * FROM supplier AS s, customer AS c, orders AS o WHERE s.s_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey",
    "star": "SELECT * FROM lineitem AS l, part AS p, supplier AS s, orders AS o WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND p.p_size < 20 AND s.s_acctbal > 0",
    "snowflake": "SELECT * FROM lineitem AS l, orders AS o, customer AS c, nation AS n, region AS r WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' AND o.o_orderdate < '1996-01-01'::timestamp",
    "self": "SELECT * FROM orders AS a, orders AS b WHERE a.o_custkey = b.o_custkey AND a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '2-HIGH'",
    "three_aliases": "SELECT * FROM events AS a, events AS b, events AS c WHERE a.user_id = b.user_id AND b.user_id = c.user_id AND a.event_type = 'purchase' AND b.value > 90 AND c.value < 10",
    "implied": "SELECT * FROM supplier AS s, customer AS c, nation AS n WHERE s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey AND s.s_nationkey = c.c_nationkey AND n.n_name LIKE '%A%'",
    "cyclic": "SELECT * FROM lineitem AS l, orders AS o, customer AS c, supplier AS s WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey",
    "two_columns": "SELECT * FROM lineitem AS a, lineitem AS b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey",
    "key_filter": "SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey AND p.p_brand = 'Brand#11' AND l.l_quantity BETWEEN 5 AND 10",
    "like_filter": "SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey AND p.p_name LIKE '%red%' AND p.p_type IN ('STANDARD', 'PROMO', 'ECONOMY')",
    "not_like_filter": "SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey AND p.p_name NOT LIKE '%red%' AND p.p_brand != 'Brand#11'",
    "disjunction": "SELECT * FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey AND (c.c_mktsegment = 'BUILDING' OR c.c_acctbal < 0)",
    "empty": "SELECT * FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'absent'",
    "parts": "SELECT * FROM region AS r, nation AS n, supplier AS s WHERE n.n_nationkey = s.s_nationkey AND r.r_name = 'ASIA'",
    "single": "SELECT * FROM orders AS o WHERE o.o_totalprice > 200000.0 AND o.o_orderpriority = '1-URGENT'",
}


def _count_sql(q: str) -> str:
    return q.replace("SELECT * FROM", "SELECT count(*)::BIGINT AS n FROM", 1)


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


for _n, _q in PREDICATES.items():
    query(f"pred_{_n}", _count_sql(_q))(lambda spark, d, q=_q: exact.joined(tables(spark, d), parse_one(q), [(next(iter(parse_one(q).tables)), _first(q))]).agg(F.count("*").alias("n")))
for _n, _q in JOINS.items():
    query(f"join_{_n}", _count_sql(_q))(lambda spark, d, q=_q: exact.counted(tables(spark, d), parse_one(q)))


def _first(q: str) -> str:
    return STAR.tables[next(iter(parse_one(q).tables.values()))].join_columns[0]


query("join_output", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 300000")(
    lambda spark, d: exact.joined(tables(spark, d), parse_one("SELECT * FROM orders AS o, customer AS c, nation AS n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND o.o_totalprice > 300000"), [("o", "o_orderkey"), ("c", "c_name"), ("n", "n_name")]).toDF("o_orderkey", "c_name", "n_name")
)
query("foreign_key_join", "SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")(
    lambda spark, d: exact.foreign_key_join(tables(spark, d)["orders"].select("o_orderkey", "o_custkey"), "o_custkey", tables(spark, d)["customer"], "c_custkey", ["c_mktsegment"])
)
query("full_outer_join", "SELECT o.o_orderkey, c.c_custkey FROM orders o FULL OUTER JOIN customer c ON o.o_custkey = c.c_custkey")(
    lambda spark, d: exact.full_outer(tables(spark, d)["orders"].select("o_orderkey", "o_custkey"), "o_custkey", tables(spark, d)["customer"].select("c_custkey"), "c_custkey").select("o_orderkey", "c_custkey")
)
query("anti_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")(
    lambda spark, d: exact.unmatched(tables(spark, d)["customer"].select("c_custkey"), "c_custkey", tables(spark, d)["orders"], "o_custkey")
)
query("semi_matched", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(
    lambda spark, d: exact.matched(tables(spark, d)["customer"].select("c_custkey"), "c_custkey", tables(spark, d)["orders"], "o_custkey")
)
query("fan_out", "SELECT c_custkey, count(o_orderkey)::BIGINT AS mul, greatest(count(o_orderkey), 1)::BIGINT AS mul_nn FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(
    lambda spark, d: exact.fan_out(tables(spark, d)["customer"].select("c_custkey"), "c_custkey", tables(spark, d)["orders"], "o_custkey")
)
query("without_key_tables", "SELECT count(*)::BIGINT AS n FROM lineitem l, orders o, part p WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey = p.p_partkey AND l.l_quantity < 5")(
    lambda spark, d: exact.joined(tables(spark, d), parse_one("SELECT * FROM lineitem AS l, orders AS o, part AS p WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey = p.p_partkey AND l.l_quantity < 5").without_key_tables(STAR)).agg(F.count("*").alias("n"))
)
query("with_key_tables", _count_sql(JOINS["two_tables"]))(lambda spark, d: exact.joined(tables(spark, d), parse_one(JOINS["two_tables"]).with_key_tables(STAR)).agg(F.count("*").alias("n")))


@query("subquery_sizes", "SELECT 'c,o' AS aliases, count(*)::BIGINT AS n FROM customer c, orders o WHERE c.c_custkey = o.o_custkey UNION ALL SELECT 'c,s', count(*)::BIGINT FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey UNION ALL SELECT 'c,o,s', count(*)::BIGINT FROM customer c, orders o, supplier s WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = s.s_nationkey")
def subquery_sizes(spark: SparkSession, d: str) -> DataFrame:
    t, out = tables(spark, d), None
    for q in parse_one(JOINS["chain"]).subqueries():
        one = exact.counted(t, q).select(F.lit(",".join(sorted(q.tables))).alias("aliases"), "n")
        out = one if out is None else out.union(one)
    return out


# --- bounds from exact degrees

_rank = "SELECT d, row_number() OVER (ORDER BY d DESC) AS rk FROM (SELECT count(*) AS d FROM {0} WHERE {1} IS NOT NULL GROUP BY {1})"
query("dsb_two_table", f"WITH r AS ({_rank.format('supplier', 's_nationkey')}), s AS ({_rank.format('customer', 'c_nationkey')}) SELECT CAST(sum(r.d * s.d) AS BIGINT) AS dsb FROM r JOIN s ON r.rk = s.rk")(
    lambda spark, d: exact.star_bound([(tables(spark, d)["supplier"], "s_nationkey"), (tables(spark, d)["customer"], "c_nationkey")])
)
query("dsb_star", f"WITH a AS ({_rank.format('lineitem', 'l_suppkey')}), b AS ({_rank.format('lineitem', 'l_partkey')}), c AS ({_rank.format('orders', 'o_custkey')}) SELECT CAST(sum(a.d * b.d * c.d) AS BIGINT) AS dsb FROM a JOIN b ON a.rk = b.rk JOIN c ON a.rk = c.rk")(
    lambda spark, d: exact.star_bound([(tables(spark, d)["lineitem"], "l_suppkey"), (tables(spark, d)["lineitem"], "l_partkey"), (tables(spark, d)["orders"], "o_custkey")])
)
_CHAIN = """
WITH sx AS (SELECT d, row_number() OVER (ORDER BY d DESC) rk FROM (SELECT count(*) d FROM supplier GROUP BY s_nationkey)),
     cx AS (SELECT rk, d, hi - d lo, hi FROM (SELECT row_number() OVER (ORDER BY d DESC, k) rk, d, sum(d) OVER (ORDER BY d DESC, k ROWS UNBOUNDED PRECEDING) hi FROM (SELECT c_nationkey k, count(*) d FROM customer GROUP BY c_nationkey))),
     cy AS (SELECT rk, d, hi - d lo, hi FROM (SELECT row_number() OVER (ORDER BY d DESC, k) rk, d, sum(d) OVER (ORDER BY d DESC, k ROWS UNBOUNDED PRECEDING) hi FROM (SELECT c_custkey k, count(*) d FROM customer GROUP BY c_custkey))),
     push AS (SELECT cy.rk, sum((least(cy.hi, cx.hi) - greatest(cy.lo, cx.lo)) * coalesce(sx.d, 0)) w FROM cy JOIN cx ON cy.lo < cx.hi AND cx.lo < cy.hi LEFT JOIN sx ON sx.rk = cx.rk GROUP BY cy.rk),
     o AS (SELECT d, row_number() OVER (ORDER BY d DESC) rk FROM (SELECT count(*) d FROM orders GROUP BY o_custkey)),
     p AS (SELECT w, row_number() OVER (ORDER BY w DESC) rk FROM push)
SELECT CAST(sum(p.w * o.d) AS BIGINT) AS dsb FROM p JOIN o ON p.rk = o.rk
"""


@query("dsb_chain", _CHAIN)
def dsb_chain(spark: SparkSession, d: str) -> DataFrame:
    """Supplier - customer - orders, through customer, from exact degrees at one root."""
    q = parse_one(JOINS["chain"])
    functions = bound.scanned_functions(tables(spark, d), q)
    return _frame(spark, [(round(bound.tree_bound(q, next(q.spanning_trees(1)), functions, "o")),)], "dsb long")


# --- conditioned statistics


@query("mcv_topk", "SELECT p_name AS value, count(*)::BIGINT AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY n DESC, value LIMIT 20")
def mcv_topk(spark: SparkSession, d: str) -> DataFrame:
    return statistics.common_values(tables(spark, d)["part"], "p_name", 20)


_MCV = "(SELECT o_totalprice::INT % 50 AS f, o_custkey AS k, o_orderkey FROM orders)"
query("quantile_edges", "SELECT i::BIGINT AS i, (SELECT v FROM (SELECT l_extendedprice v, row_number() OVER (ORDER BY l_extendedprice) r FROM lineitem) WHERE r = floor((SELECT count(*) FROM lineitem) * i / 16)::BIGINT + 1) AS edge FROM range(1, 16) t(i)")(
    lambda spark, d: exact.quantile_edges(tables(spark, d)["lineitem"], "l_extendedprice", 15)
)
query("degree_rle_by_value", "SELECT f AS value, d, count(*)::BIGINT AS n FROM (SELECT o_orderpriority f, o_custkey k, count(*)::BIGINT d FROM orders GROUP BY ALL) GROUP BY ALL")(
    lambda spark, d: statistics.bucket_runs(statistics.pair_counts(tables(spark, d)["orders"], ("o_custkey",), "o_orderpriority").where("column <> '*'").withColumn("bucket", F.col("f"))).select(F.col("bucket").alias("value"), "d", "n")
)
query("null_degree_rle", "SELECT no_order AS is_null, d, count(*)::BIGINT AS n FROM (SELECT o_orderkey IS NULL AS no_order, c_nationkey k, count(*)::BIGINT d FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY ALL")(
    lambda spark, d: statistics.bucket_runs(
        statistics.pair_counts(tables(spark, d)["customer"].join(tables(spark, d)["orders"], F.col("c_custkey") == F.col("o_custkey"), "left"), ("c_nationkey",), "o_orderkey").where("column <> '*'").withColumn("bucket", F.col("f").isNull())
    ).select(F.col("bucket").alias("is_null"), "d", "n")
)
query("interval_degree_rle", "SELECT b AS bucket, d, count(*)::BIGINT AS n FROM (SELECT k, b, count(*)::BIGINT d FROM (SELECT l_suppkey k, (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS b FROM lineitem) GROUP BY ALL) GROUP BY ALL")(
    lambda spark, d: statistics.bucket_runs(statistics.pair_counts(tables(spark, d)["lineitem"], ("l_suppkey",), "l_quantity").where("column <> '*'").withColumn("bucket", statistics.base_bucket(F.col("f"), [10.0, 20.0, 30.0, 40.0]))).select("bucket", "d", "n")
)
query("remainder_max_degrees", "SELECT d, count(*)::BIGINT AS n FROM (SELECT r, max(c)::BIGINT AS d FROM (SELECT c, row_number() OVER (PARTITION BY f ORDER BY c DESC) r FROM (SELECT p_type f, l_suppkey k, count(*) c FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT IN (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 2) GROUP BY ALL)) GROUP BY r) GROUP BY d")(
    lambda spark, d: _remainder(tables(spark, d))
)


def _remainder(t: dict[str, DataFrame]) -> DataFrame:
    top = [r["value"] for r in statistics.common_values(t["part"], "p_type", 2).collect()]
    rows = exact.foreign_key_join(t["lineitem"], "l_partkey", t["part"], "p_partkey", ["p_type"])
    counts = statistics.pair_counts(rows, ("l_suppkey",), "p_type").where("column <> '*'").where(~F.col("f").isin(*top))
    return statistics.rank_maximum(counts, "f").select("d", "n")


_GRAM = "(SELECT DISTINCT p_partkey, substr(p_name, i::INT, 3) AS g FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part WHERE length(p_name) >= 3))"
query("trigram_topk", f"SELECT g AS value, count(*)::BIGINT AS n FROM {_GRAM} GROUP BY g ORDER BY n DESC, g LIMIT 20")(
    lambda spark, d: statistics.common_values(tables(spark, d)["part"].select(F.explode(grams(F.col("p_name"))).alias("g")), "g", 20)
)
query("trigram_degree_rle", f"SELECT g, d, count(*)::BIGINT AS n FROM (SELECT g, l_suppkey k, count(*)::BIGINT d FROM lineitem JOIN {_GRAM} ON l_partkey = p_partkey GROUP BY ALL) GROUP BY ALL")(
    lambda spark, d: statistics.bucket_runs(
        statistics.pair_counts(exact.foreign_key_join(tables(spark, d)["lineitem"], "l_partkey", tables(spark, d)["part"], "p_partkey", ["p_name"]), ("l_suppkey",), "p_name").where("column <> '*'").withColumn("bucket", F.explode(grams(F.col("f"))))
    ).select(F.col("bucket").alias("g"), "d", "n")
)
query("fk_filtered_degree_rle", "SELECT c_mktsegment AS value, d, count(*)::BIGINT AS n FROM (SELECT c_mktsegment, o_custkey, count(*)::BIGINT d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL")(
    lambda spark, d: statistics.bucket_runs(
        statistics.pair_counts(exact.foreign_key_join(tables(spark, d)["orders"].select("o_custkey"), "o_custkey", tables(spark, d)["customer"], "c_custkey", ["c_mktsegment"]), ("o_custkey",), "c_mktsegment").where("column <> '*'").withColumn("bucket", F.col("f"))
    ).select(F.col("bucket").alias("value"), "d", "n")
)


# --- bounds from statistics

SMALL = statistics.Options(buckets=16, common_values=100, groups=16, common_grams=100)
CORE = Schema.of(
    [
        TableSpec("region", ("r_regionkey",), ("r_name",)),
        TableSpec("nation", ("n_nationkey", "n_regionkey"), ("n_name",)),
        TableSpec("supplier", ("s_suppkey", "s_nationkey"), ("s_acctbal",)),
        TableSpec("customer", ("c_custkey", "c_nationkey"), ("c_mktsegment", "c_acctbal")),
        TableSpec("part", ("p_partkey",), ("p_name", "p_brand", "p_type", "p_size")),
        TableSpec("orders", ("o_orderkey", "o_custkey"), ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        TableSpec("lineitem", ("l_orderkey", "l_partkey", "l_suppkey"), ("l_quantity",)),
        TableSpec("events", ("user_id",), ("event_type", "value")),
    ],
    [fk for fk in STAR.foreign_keys if (fk.table, fk.key_table) != ("lineitem", "orders")] + [ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")],
)
#: For each session and folder, what was built for which needs (None: for all).
_built: dict[tuple[str, str], list[tuple[dict[str, statistics.Need] | None, statistics.Statistics]]] = {}


def core_statistics(spark: SparkSession, d: str, queries: Sequence[Query] | None = None) -> statistics.Statistics:
    """All, or those that bounds and plans of some queries look up; built once for each session and folder."""
    kept = _built.setdefault((spark.sparkContext.applicationId, d), [])
    need = None if queries is None else bound.needs(CORE, queries)
    for have, stats in kept:
        if have is None or (need is not None and all(t in have and have[t].covers(n) for t, n in need.items())):
            return stats
    kept.append((need, statistics.build(tables(spark, d) if need is None else tables(spark, d, need), CORE, SMALL, needs=need)))
    return kept[-1][1]


def _truth(names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS bound_ok FROM {q.split(' FROM ', 1)[1]}" for n, q in names.items())


def bounds(spark: SparkSession, d: str, names: dict[str, str], of: Callable[[Query], float]) -> DataFrame:
    t, rows = tables(spark, d), []
    for n, sql in names.items():  # one after the other, so that no two joins' shuffles are needed at once
        q = parse_one(sql)
        truth, b = exact.count(t, q), float(of(q))
        rows.append((n, truth, b * (1 + 1e-9) >= truth, b))
    return _frame(spark, rows, "query string, truth long, bound_ok boolean, bound double")


_plain = {f"pred_{k}": v for k, v in PREDICATES.items() if k != "in_query"}
query("bound_vs_true_joins", _truth(JOINS))(lambda spark, d: bounds(spark, d, JOINS, lambda q: bound.bound(core_statistics(spark, d), q)).drop("bound"))
query("bound_vs_true_predicates", _truth(_plain))(lambda spark, d: bounds(spark, d, _plain, lambda q: bound.bound(core_statistics(spark, d), q)).drop("bound"))
query("scanned_bound_vs_true", _truth(JOINS))(lambda spark, d: _scanned(spark, d).drop("bound"))
query("maxfreq_bound_vs_true", _truth({k: JOINS[k] for k in ("two_tables", "chain", "self", "key_filter")}))(
    lambda spark, d: bounds(spark, d, {k: JOINS[k] for k in ("two_tables", "chain", "self", "key_filter")}, lambda q: float(bound.scanned_max_frequency_bound(tables(spark, d), q))).drop("bound")
)
query("maxfreq_bound", "WITH a AS (SELECT count(*) n FROM supplier), b AS (SELECT count(*) n FROM customer), x AS (SELECT max(d) d FROM (SELECT count(*) d FROM supplier GROUP BY s_nationkey)), y AS (SELECT max(d) d FROM (SELECT count(*) d FROM customer GROUP BY c_nationkey)) SELECT least(a.n * y.d, b.n * x.d)::BIGINT AS bound FROM a, b, x, y")(
    lambda spark, d: _frame(spark, [(int(bound.scanned_max_frequency_bound(tables(spark, d), parse_one(JOINS["two_tables"]))),)], "bound long")
)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    cache: dict = {}
    return bounds(spark, d, JOINS, lambda q: bound.scanned_bound(tables(spark, d), q, cache))


query("q_error_quantiles", "SELECT 'avg' AS method, round(quantile_cont(q, 0.05), 6) AS q05, round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.95), 6) AS q95 FROM (SELECT greatest(e / t, t / e) AS q FROM (SELECT count(*)::DOUBLE AS t, 10.0::DOUBLE AS e FROM orders GROUP BY o_custkey))")(
    lambda spark, d: estimators.q_errors(exact.degrees(tables(spark, d)["orders"], "o_custkey").select(F.lit("avg").alias("method"), F.lit(10.0).alias("estimate"), F.col("d").alias("truth")))
)
for _n in ("chain", "star", "snowflake", "cyclic", "disjunction", "parts"):
    query(f"planned_join_{_n}", _count_sql(JOINS[_n]))(lambda spark, d, q=parse_one(JOINS[_n]): planner.planned_count(tables(spark, d, set(q.tables.values())), core_statistics(spark, d, [q]), q))

# --- networks

query("contingency", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")(lambda spark, d: bayes.contingency(tables(spark, d)["orders"], "o_orderstatus", ["o_orderpriority"]))
query("conditional_table", "SELECT o_orderstatus, o_orderpriority, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 9) AS p FROM (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)")(
    lambda spark, d: bayes.conditional_table(tables(spark, d)["orders"], "o_orderstatus", "o_orderpriority").withColumn("p", F.round("p", 9))
)
query("conditional_table_prior", "SELECT o_orderstatus, o_orderpriority, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 9) AS p FROM (SELECT s.o_orderstatus, p.o_orderpriority, count(o_orderkey)::DOUBLE + 1 AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL)")(
    lambda spark, d: bayes.conditional_table(tables(spark, d)["orders"], "o_orderstatus", "o_orderpriority", 1.0).withColumn("p", F.round("p", 9))
)
query(
    "mutual_information",
    "WITH b AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) n FROM b), x AS (SELECT a, sum(n) n FROM b GROUP BY a), y AS (SELECT b, sum(n) n FROM b GROUP BY b) SELECT round(sum(b.n / t.n * ln(b.n * t.n / (x.n * y.n))), 9) AS mi FROM b JOIN x ON b.a = x.a JOIN y ON b.b = y.b, t",
)(lambda spark, d: bayes.mutual_information(tables(spark, d)["lineitem"], "l_returnflag", "l_linestatus").withColumn("mi", F.round("mi", 9)))
query("covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")(
    lambda spark, d: tables(spark, d)["lineitem"].agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))
)


query("dependency", "SELECT DISTINCT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IS NOT NULL")(lambda spark, d: prepare.dependency(tables(spark, d)["nation"], "n_nationkey", "n_regionkey"))
query("categorical_codes", "SELECT p_type AS value, (row_number() OVER (ORDER BY n DESC, p_type) - 1)::BIGINT AS code FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")(
    lambda spark, d: prepare.categorical_codes(tables(spark, d)["part"], "p_type")
)
query(
    "chi_square",
    "WITH b AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY ALL), x AS (SELECT a, sum(n) n FROM b GROUP BY a), y AS (SELECT b, sum(n) n FROM b GROUP BY b), t AS (SELECT sum(n) n FROM b) SELECT round((SELECT n FROM t) * (sum(b.n * b.n / (x.n * y.n)) - 1), 6) AS chi2, ((SELECT count(*) FROM x) - 1) * ((SELECT count(*) FROM y) - 1) AS degrees FROM b JOIN x ON b.a = x.a JOIN y ON b.b = y.b",
)(lambda spark, d: prepare.chi_square(tables(spark, d)["orders"], "o_orderstatus", "o_orderpriority").withColumn("chi2", F.round("chi2", 6)))

# --- aggregate queries

AGGREGATES = {
    "count": "SELECT l_returnflag, COUNT(*) FROM lineitem AS l WHERE l.l_quantity < 25 GROUP BY l_returnflag",
    "sum": "SELECT l.l_returnflag, l.l_linestatus, SUM(l.l_quantity) FROM lineitem AS l GROUP BY l.l_returnflag, l.l_linestatus ORDER BY l_returnflag",
    "avg": "SELECT c.c_mktsegment, AVG(o.o_totalprice) FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "product": "SELECT SUM(l.l_extendedprice * l.l_discount) FROM lineitem AS l WHERE l.l_discount BETWEEN 0.05 AND 0.07 AND l.l_quantity < 24",
    "difference": "SELECT l.l_linestatus, SUM(l.l_extendedprice) - SUM(l.l_extendedprice * l.l_discount) FROM lineitem AS l GROUP BY l.l_linestatus",
}


def _aggregate_sql(sql: str) -> str:
    head, tail = sql.split(" ORDER BY ")[0].split(" FROM ", 1)
    columns = head.removeprefix("SELECT ").rsplit(", ", 1)
    return f"SELECT {columns[0] + ', ' if len(columns) > 1 else ''}round(({columns[-1]})::DOUBLE, 2) AS value FROM {tail}"


for _n, _q in AGGREGATES.items():
    query(f"aqp_exact_{_n}", _aggregate_sql(_q))(lambda spark, d, q=_q: aggregates.evaluate(tables(spark, d), parse_aggregate(q)).withColumn("value", F.round("value", 2)))
query("what_if_count", "SELECT o_orderstatus, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.2 ELSE 1.0 END)::DOUBLE, 4) AS value FROM orders GROUP BY o_orderstatus")(
    lambda spark, d: aggregates.evaluate(tables(spark, d), parse_aggregate("SELECT o.o_orderstatus, COUNT(*) FROM orders AS o GROUP BY o.o_orderstatus WHAT IF o.o_orderpriority = '1-URGENT' INCREASE BY 20%")).withColumn("value", F.round("value", 4))
)
query("what_if_sum", "SELECT round(sum(o_totalprice * CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE 1.0 END), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda spark, d: aggregates.evaluate(tables(spark, d), parse_aggregate("SELECT SUM(o.o_totalprice) FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey WHAT IF c.c_mktsegment = 'BUILDING' DECREASE BY 50%")).withColumn("value", F.round("value", 2))
)

# --- the rest

query("distinct_counts", "SELECT count(DISTINCT p_name)::BIGINT AS names, count(DISTINCT p_size)::BIGINT AS sizes, min(p_size) AS low, max(p_size) AS high FROM part")(
    lambda spark, d: tables(spark, d)["part"].agg(F.count_distinct("p_name").alias("names"), F.count_distinct("p_size").alias("sizes"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))
)
query("epoch_offset", "SELECT event_id, (epoch(ts)::BIGINT - epoch(TIMESTAMP '2010-07-19 00:00:00')::BIGINT)::BIGINT AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")(
    lambda spark, d: tables(spark, d)["events"].select("event_id", epoch_offset(F.date_trunc("second", "ts")).alias("seconds"))
)
query("log_bins", "SELECT floor(log10(o_totalprice))::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 0 GROUP BY 1")(
    lambda spark, d: tables(spark, d)["orders"].where("o_totalprice > 0").groupBy(F.floor(F.log10("o_totalprice")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
)
query("top_per_group", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")(
    lambda spark, d: _top(tables(spark, d)["customer"])
)


def _top(customers: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return customers.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey")


@query("incremental_degree_rle", "SELECT d, count(*)::BIGINT AS n FROM (SELECT count(*)::BIGINT AS d FROM events WHERE user_id IS NOT NULL GROUP BY user_id) GROUP BY d")
def incremental_degree_rle(spark: SparkSession, d: str) -> DataFrame:
    """Degree runs kept by a stream over the events table."""
    root = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rowceil-")).rstrip("/")
    import uuid

    root = f"{root}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    incremental.maintain(source, ["user_id"], f"{root}/counts", f"{root}/state").awaitTermination()
    return incremental.current_runs(spark, f"{root}/counts", "user_id")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Truth, bounds from exact degrees and from largest degrees of some joins."""
    t, rows = tables(spark, d), []
    for n in ("two_tables", "chain", "self", "implied"):
        q = parse_one(JOINS[n])
        truth, dsb, most = exact.count(t, q), bound.scanned_bound(t, q), float(bound.scanned_max_frequency_bound(t, q))
        rows.append((n, truth, dsb, most, dsb * (1 + 1e-9) >= truth))
    return _frame(spark, rows, "query string, true_card long, dsb double, maxfreq double, bound_ok boolean")
