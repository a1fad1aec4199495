"""Further queries: operators whose results one statement of SQL can tell too, exactly or as lying within stated limits of the truth."""

from __future__ import annotations

import random
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom
from .functions.factors import Factor, calibrate, eliminate, most_probable
from .functions.step import ZERO, Step, cluster, compress, maximum, minimum, product, total
from .functions.text import grams, hash_sample, stripped
from .model import STAR, ForeignKey
from .operators import aggregates, bayes, ensemble, estimators, exact, prepare, statistics
from .operators.spn import SumProductNetwork
from .plans import bound
from .plans.functions import register_bound
from .plans.parser import parse_aggregate, parse_one
from .queries import AGGREGATES, CORE, JOINS, SMALL, _count_sql, _frame, core_statistics, query, tables
from .sources import synthetic
from .sources import tables as sources


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; in tests, which set none, a temporary one."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rowceil-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def _values(*rows: str) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


# --- statistics

_TOP = "SELECT g FROM {gram} GROUP BY g ORDER BY count(*) DESC, g LIMIT 20"
_GRAM = "(SELECT DISTINCT p_partkey, substr(p_name, i::INT, 3) AS g FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part WHERE length(p_name) >= 3))"


@query("rare_gram_degrees", f"SELECT d, count(*)::BIGINT AS n FROM (SELECT r, max(c)::BIGINT AS d FROM (SELECT c, row_number() OVER (PARTITION BY g ORDER BY c DESC) r FROM (SELECT g, l_suppkey k, count(*) c FROM lineitem JOIN {_GRAM} ON l_partkey = p_partkey WHERE g NOT IN ({_TOP.format(gram=_GRAM)}) GROUP BY ALL)) GROUP BY r) GROUP BY d")
def rare_gram_degrees(spark: SparkSession, d: str) -> DataFrame:
    """The largest degree at each rank over all grams but the 20 most common."""
    t = tables(spark, d)
    top = [r["value"] for r in statistics.common_values(t["part"].select(F.explode(grams(F.col("p_name"))).alias("g")), "g", 20).collect()]
    rows = exact.foreign_key_join(t["lineitem"], "l_partkey", t["part"], "p_partkey", ["p_name"])
    counts = statistics.pair_counts(rows, ("l_suppkey",), "p_name").where("column <> '*'").withColumn("g", F.explode(grams(F.col("f")))).where(~F.col("g").isin(*top))
    return statistics.rank_maximum(counts, "g").select("d", "n")


@query("rare_value_rows", "SELECT max(n)::BIGINT AS most FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderdate) AS r FROM orders GROUP BY o_orderdate) WHERE r > 100")
def rare_value_rows(spark: SparkSession, d: str) -> DataFrame:
    """The most rows of a value that is not among the 100 most common."""
    (found,) = statistics.filter_statistics(tables(spark, d)["orders"].select("o_custkey", "o_orderdate"), ("o_custkey",), ("o_orderdate",), SMALL)
    return _frame(spark, [(round(found.rest[statistics.ROWS].total),)], "most long")


@query("null_statistics", "SELECT (count(*) - count(o_orderkey))::BIGINT AS null_rows, count(o_orderkey)::BIGINT AS other_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def null_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    rows = t["customer"].join(t["orders"].where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", "o_orderkey")
    (found,) = statistics.filter_statistics(rows, ("c_nationkey",), ("o_orderkey",), SMALL)
    return _frame(spark, [tuple(round(f.get(statistics.ROWS, ZERO).total) for f in (found.null, found.not_null))], "null_rows long, other_rows long")


@query("bound_of_empty_tables", "SELECT count(*)::BIGINT AS truth, 0::BIGINT AS bound, 0::BIGINT AS bound_of_null FROM orders WHERE o_orderkey IS NULL")
def bound_of_empty_tables(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a table without rows, and of one whose filter column is null throughout, bound what they select by none."""
    t = tables(spark, d)
    small = statistics.build({**t, "orders": t["orders"].where("o_orderkey IS NULL"), "customer": t["customer"].withColumn("c_mktsegment", F.lit(None).cast("string"))}, STAR, SMALL, {"orders", "customer"})
    q, r = parse_one("SELECT * FROM orders AS o WHERE o.o_orderstatus = 'F'"), parse_one("SELECT * FROM customer AS c WHERE c.c_mktsegment = 'BUILDING'")
    return _frame(spark, [(exact.count({"orders": t["orders"].where("o_orderkey IS NULL")}, parse_one("SELECT * FROM orders AS o")), round(bound.bound(small, q)), round(bound.bound(small, r)))], "truth long, bound long, bound_of_null long")


@query("distinct_edges", "WITH q AS (SELECT DISTINCT p_size AS edge FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) r FROM part) WHERE r IN (SELECT floor((SELECT count(*) FROM part) * i / 31)::BIGINT + 1 FROM range(1, 31) t(i))), m AS (SELECT p_size AS edge FROM part WHERE p_size NOT IN (SELECT edge FROM q) GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT (SELECT 30 - count(*) FROM q)) SELECT edge FROM q UNION ALL SELECT edge FROM m")
def distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    return exact.distinct_edges(tables(spark, d)["part"], "p_size", 30)


#: Largest ratio of bound to truth that statistics may give for these joins of the driver's tables.
TIGHT = {"two_tables": 1.5, "chain": 10.0, "star": 12.0, "snowflake": 60.0, "key_filter": 8.0, "like_filter": 8.0, "disjunction": 2.0, "single": 8.0, "implied": 20.0}


@query("bound_tightness", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS tight FROM {JOINS[n].split(' FROM ', 1)[1]}" for n in TIGHT))
def bound_tightness(spark: SparkSession, d: str) -> DataFrame:
    """Whether bounds from statistics lie between the truth and TIGHT times it."""
    rows = []
    for n, limit in TIGHT.items():
        q = parse_one(JOINS[n])
        truth, b = exact.count(tables(spark, d), q), bound.bound(core_statistics(spark, d), q)
        rows.append((n, truth, bool(truth <= b * (1 + 1e-9) and b <= limit * max(1, truth))))
    return _frame(spark, rows, "query string, truth long, tight boolean")


@query("saved_statistics", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS same FROM {JOINS[n].split(' FROM ', 1)[1]}" for n in ("key_filter", "like_filter", "disjunction")))
def saved_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics that were written and read give the same bounds."""
    stats, path, rows = core_statistics(spark, d), _folder(spark), []
    statistics.save(spark, stats, path)
    again = statistics.load(spark, path, stats.schema, stats.options)
    for n in ("key_filter", "like_filter", "disjunction"):
        q = parse_one(JOINS[n])
        rows.append((n, exact.count(tables(spark, d), q), bound.bound(again, q) == bound.bound(stats, q)))
    return _frame(spark, rows, "query string, truth long, same boolean")


@query("bound_function", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS bound_ok FROM {JOINS[n].split(' FROM ', 1)[1]}" for n in ("two_tables", "key_filter", "disjunction")))
def bound_function(spark: SparkSession, d: str) -> DataFrame:
    """Bounds by the table function, beside the truth."""
    register_bound(spark, core_statistics(spark, d))
    out = None
    for n in ("two_tables", "key_filter", "disjunction"):
        literal = JOINS[n].replace("'", "\\'")
        found = spark.sql(f"SELECT * FROM dsb_bound('{literal}')")
        one = exact.counted(tables(spark, d), parse_one(JOINS[n])).withColumnRenamed("n", "truth").crossJoin(F.broadcast(found)).select(F.lit(n).alias("query"), "truth", (F.col("bound") * (1 + 1e-9) >= F.col("truth")).alias("bound_ok"))  # one row each
        out = one if out is None else out.union(one)
    return out


@query("random_workload", "SELECT count(*)::BIGINT AS queries, TRUE AS safe FROM range(12)")
def random_workload(spark: SparkSession, d: str) -> DataFrame:
    """Random joins with predicates on values that occur: no bound is below the truth."""
    t, rng = tables(spark, d), random.Random(5)
    values = {n: {c: [r[0] for r in t[n].select(c).where(F.col(c).isNotNull()).distinct().orderBy(F.xxhash64(c)).limit(20).collect()] for c in CORE.tables[n].filter_columns} for n in ("orders", "customer", "part", "lineitem")}
    asked = [synthetic.random_query(CORE, values, rng, rng.randint(1, 3), rng.randint(1, 3)) for _ in range(12)]
    stats = core_statistics(spark, d, asked)
    safe = [bound.bound(stats, q) * (1 + 1e-9) >= exact.count(t, q) for q in asked]
    return _frame(spark, [(len(safe), all(safe))], "queries long, safe boolean")


# --- step functions

_RANKS = "SELECT row_number() OVER (ORDER BY d DESC) AS rk, d FROM (SELECT count(*) AS d FROM {0} WHERE {1} IS NOT NULL GROUP BY {1})"
_PAIR = f"a AS ({_RANKS.format('lineitem', 'l_suppkey')}), b AS ({_RANKS.format('orders', 'o_custkey')}), x AS (SELECT unnest([1, 3, 10, 40, 100000]) AS x)"


def _exact_step(df: DataFrame, column: str) -> Step:
    runs = exact.degree_runs(df, column).collect()
    return Step.of_degrees([r["d"] for r in runs], [r["n"] for r in runs])


def _pair(spark: SparkSession, d: str) -> tuple[Step, Step]:
    t = tables(spark, d)
    return _exact_step(t["lineitem"], "l_suppkey"), _exact_step(t["orders"], "o_custkey")


@query("step_values", f"WITH {_PAIR} SELECT x::BIGINT AS keys, coalesce((SELECT max(d) FROM b WHERE rk = x), 0)::BIGINT AS degree, coalesce((SELECT sum(d) FROM b WHERE rk <= x), 0)::BIGINT AS rows, least(x, (SELECT count(*) FROM b))::BIGINT AS keys_again FROM x")
def step_values(spark: SparkSession, d: str) -> DataFrame:
    """Degree at a rank, rows of the keys up to it, and the keys that hold so many rows."""
    _, b = _pair(spark, d)
    return _frame(spark, [(x, round(float(b.value_at(x))), round(float(b.rows_at(x))), round(float(b.inverse(b.rows_at(x))))) for x in (1, 3, 10, 40, 100000)], "keys long, degree long, rows long, keys_again long")


@query("step_envelopes", f"WITH {_PAIR}, c AS (SELECT x, coalesce((SELECT sum(d) FROM a WHERE rk <= x), 0) AS ra, coalesce((SELECT sum(d) FROM b WHERE rk <= x), 0) AS rb FROM x) SELECT x::BIGINT AS keys, least(ra, rb)::BIGINT AS low, (ra + rb)::BIGINT AS sum, TRUE AS high_dominates, (SELECT sum(a.d * b.d) FROM a JOIN b USING (rk) WHERE rk <= x)::BIGINT AS product FROM c")
def step_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Pointwise least, sum and product of two functions, and whether their envelope is nowhere below either."""
    a, b = _pair(spark, d)
    low, every, high, both = minimum([a, b]), total([a, b]), maximum([a, b]), product([a, b])
    rows = []
    for x in (1, 3, 10, 40, 100000):
        rows.append((x, round(float(low.rows_at(x))), round(float(every.rows_at(x))), bool(high.rows_at(x) * (1 + 1e-9) >= max(a.rows_at(x), b.rows_at(x))), round(float(both.rows_at(x)))))
    return _frame(spark, rows, "keys long, low long, sum long, high_dominates boolean, product long")


@query("step_parts", f"WITH {_PAIR} SELECT (SELECT sum(d) FROM a WHERE rk <= 7)::BIGINT AS first_keys, (SELECT sum(d) FROM a WHERE rk > 7)::BIGINT AS other_keys, ((SELECT sum(d) FROM a) // 2)::BIGINT AS half, ((SELECT sum(d) FROM a) + (SELECT sum(d) FROM b))::BIGINT AS joined, (SELECT sum(d * d) FROM a)::BIGINT AS self_join, (SELECT sum(d * d) FROM a)::DOUBLE / (SELECT sum(d * d) FROM b) >= 1 AS heavier")
def step_parts(spark: SparkSession, d: str) -> DataFrame:
    """Cut by keys, truncated by rows, put before each other, and weighed."""
    a, b = _pair(spark, d)
    half = a.total // 2
    return _frame(spark, [(round(a.cut(7).total), round(a.after(7).total), round(a.cap(half).total), round(a.before(b).total), round(a.self_join()), bool(abs(a.distance(b) - max(a.self_join() / b.self_join(), b.self_join() / a.self_join())) < 1e-6) and a.self_join() >= b.self_join())], "first_keys long, other_keys long, half long, joined long, self_join long, heavier boolean")


_STEPS = [("lineitem", "l_partkey"), ("orders", "o_custkey"), ("events", "user_id")]
_WAYS = [(s, m) for s in ("relative", "exponential", "linear", "equidepth") for m in ("cdf", "pdf")]


@query("step_functions", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({c})::BIGINT AS rows FROM {t}" for t, c in _STEPS) + ") SELECT \"table\", \"column\", strategy, mode, CASE WHEN mode = 'cdf' THEN rows END AS rows, TRUE AS few, TRUE AS dominates FROM t, " + _values(*(f"('{s}', '{m}')" for s, m in _WAYS)) + " AS w(strategy, mode)")
def step_functions(spark: SparkSession, d: str) -> DataFrame:
    """Compressed degree functions by strategy and mode: their rows, which mode cdf keeps; whether they have no more than 20 segments; and whether they are nowhere below the exact function."""
    rows = []
    for t, c in _STEPS:
        runs = exact.degree_runs(tables(spark, d)[t], c).collect()
        degrees, counts = [r["d"] for r in runs], [r["n"] for r in runs]
        true = Step.of_degrees(degrees, counts)
        for strategy, mode in _WAYS:
            f = compress(degrees, counts, 0.01, strategy, mode, 20)
            at = np.union1d(true.edges, f.edges)
            rows.append((t, c, strategy, mode, round(f.total) if mode == "cdf" else None, len(f.edges) <= 20, bool((f.rows_at(at) >= true.rows_at(at) * (1 - 1e-9)).all())))
    return _frame(spark, rows, "table string, column string, strategy string, mode string, rows long, few boolean, dominates boolean")


@query("clustered_scores", "SELECT label, count(*)::BIGINT AS n, min(d)::BIGINT AS low, max(d)::BIGINT AS high, TRUE AS runs FROM (SELECT d, (row_number() OVER (ORDER BY d) - 1) * 4 // count(*) OVER () AS label FROM (SELECT DISTINCT count(*) AS d FROM orders GROUP BY o_custkey)) GROUP BY label")
def clustered_scores(spark: SparkSession, d: str) -> DataFrame:
    """Different degrees in four groups of one size; and whether complete and single linkage make three runs of the sorted scores."""
    scores = [float(r["d"]) for r in exact.degree_runs(tables(spark, d)["orders"], "o_custkey").orderBy("d").collect()]
    equal, runs = cluster(scores, 4, "equal"), True
    for how in ("complete", "single"):
        labels = cluster(scores, 3, how)
        runs &= sum(a != b for a, b in zip(labels, labels[1:], strict=False)) == len(set(labels)) - 1
    by: dict[int, list[float]] = {}
    for s, x in zip(scores, equal, strict=True):
        by.setdefault(x, []).append(s)
    return _frame(spark, [(x, len(v), int(min(v)), int(max(v)), runs) for x, v in by.items()], "label long, n long, low long, high long, runs boolean")


# --- Bloom filters

_KEYS = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '{0}'"


@query("bloom_filters", f"WITH a AS ({_KEYS.format('1-URGENT')}), b AS ({_KEYS.format('2-HIGH')}) SELECT (SELECT count(*) FROM a)::BIGINT AS of_one, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b))::BIGINT AS of_union, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b))::BIGINT AS of_both, TRUE AS few_false, TRUE AS about, TRUE AS again")
def bloom_filters(spark: SparkSession, d: str) -> DataFrame:
    """Members that filters find among their keys (all of them), in a union and an intersection; whether at most one other key in fifty passes, the estimate of size is near, and a filter read from text is the same."""
    orders = tables(spark, d)["orders"]
    keys = [orders.where(F.col("o_orderpriority") == p).select("o_custkey").distinct() for p in ("1-URGENT", "2-HIGH")]
    capacity = max(200_000, keys[0].union(keys[1]).distinct().count())  # of the union, which one filter must hold too
    a, b = (bloom.build(k, "o_custkey", capacity) for k in keys)
    found = lambda df, known: bloom.members(df, "o_custkey", known).count()
    false = sum(-x - 1 in a for x in range(2000))
    n = keys[0].count()
    return _frame(spark, [(found(keys[0], a), found(keys[0].union(keys[1]).distinct(), a | b), found(keys[0].intersect(keys[1]), a & b), false <= 40, abs(a.approx_len() - n) <= 0.05 * n + 5, bloom.BloomFilter.from_base64(a.to_base64()).bit_array == a.bit_array)], "of_one long, of_union long, of_both long, few_false boolean, about boolean, again boolean")


# --- samples and estimates

@query("correlated_sample", "SELECT TRUE AS some, TRUE AS all_joined, TRUE AS none_missing")
def correlated_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of a sample that follows joins from customers to orders: it is a part, each order has its customer, each of these customers all orders."""
    t = tables(spark, d)
    made = estimators.correlated_samples(t, parse_one(JOINS["chain"]), "c", "c_custkey", 0.1)
    joined = made["o"].join(made["c"], F.col("o_custkey") == F.col("c_custkey"), "left_semi").count()
    every = t["orders"].join(t["customer"].where(hash_sample(F.col("c_custkey"), 0.1)), F.col("o_custkey") == F.col("c_custkey"), "left_semi").count()
    n = made["o"].count()
    return _frame(spark, [(0 < n < t["orders"].count(), joined == n, every == n)], "some boolean, all_joined boolean, none_missing boolean")


@query("join_sample", "SELECT 100::BIGINT AS rows, 100::BIGINT AS true_rows, TRUE AS whole")
def join_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 rows of a join: how many of them the join itself holds; and whether the sample's size is that of the join of the sampled customers."""
    t, q = tables(spark, d), parse_one(JOINS["chain"])
    out = [("c", "c_custkey"), ("o", "o_orderkey"), ("s", "s_suppkey")]
    rows, n = estimators.join_sample(t, q, "c", "c_custkey", 0.1, 100, out)
    names = [f"{a}__{c}" for a, c in out]
    held = rows.join(exact.joined(t, q, out), names, "left_semi").count()
    size = exact.count({**t, "customer": t["customer"].where(hash_sample(F.col("c_custkey"), 0.1))}, q)
    return _frame(spark, [(rows.count(), held, n == size)], "rows long, true_rows long, whole boolean")


@query("sampled_estimate", "SELECT round((SELECT count(*) FROM lineitem, part WHERE l_partkey = p_partkey) * (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 5 AND 10) / (SELECT count(*) FROM lineitem)::DOUBLE * (SELECT count(*) FROM part WHERE p_brand = 'Brand#11') / (SELECT count(*) FROM part)::DOUBLE, 3) AS estimate")
def sampled_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Selectivities, here from whole tables, times the size of the join without predicates."""
    t, q = tables(spark, d), parse_one(JOINS["key_filter"])
    size = exact.count(t, parse_one("SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey"))
    return _frame(spark, [(round(estimators.sampled_estimate(t, q, 1.0, {"lineitem": "l_orderkey", "part": "p_partkey"}, size), 3),)], "estimate double")


@query("subquery_sweep", "SELECT aliases, n, TRUE AS exact, TRUE AS bounded FROM (SELECT 'c,o' AS aliases, count(*)::BIGINT AS n FROM customer c, orders o WHERE c.c_custkey = o.o_custkey UNION ALL SELECT 'c,s', count(*)::BIGINT FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey UNION ALL SELECT 'c,o,s', count(*)::BIGINT FROM customer c, orders o, supplier s WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = s.s_nationkey)")
def subquery_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The size of every subquery within five minutes each; and whether the bound that stands in for one that takes longer is no less."""
    t, q, stats = tables(spark, d), parse_one(JOINS["chain"]), core_statistics(spark, d)
    exactly = estimators.subquery_sizes(t, q, 300.0, lambda x: bound.bound(stats, x))
    return _frame(spark, [(a, int(n), sure, bound.bound(stats, q.restricted(a.split(","))) * (1 + 1e-9) >= n) for a, n, sure in exactly], "aliases string, n long, exact boolean, bounded boolean")


@query("expected_rows", "SELECT count(*)::BIGINT AS rows FROM customer")
def expected_rows(spark: SparkSession, d: str) -> DataFrame:
    """What Spark's optimizer expects of a saved and analysed table."""
    name = f"analysed_{uuid.uuid4().hex[:12]}"
    tables(spark, d)["customer"].select("c_custkey", "c_nationkey").write.saveAsTable(name)
    try:
        estimators.analyze(spark, name, ["c_custkey", "c_nationkey"])
        return _frame(spark, [(estimators.optimizer_estimate(spark.table(name)),)], "rows long")
    finally:
        spark.sql(f"DROP TABLE {name}")


query("runtime_summary", "SELECT method, runs, round(total, 4) AS total, round(mean, 6) AS mean, round(total / max(total) OVER (), 8) AS share FROM (SELECT event_type AS method, count(*)::BIGINT AS runs, sum(value) AS total, avg(value) AS mean FROM events GROUP BY event_type)")(
    lambda spark, d: estimators.runtime_summary(tables(spark, d)["events"].select(F.col("event_type").alias("method"), F.col("value").alias("seconds"))).select("method", "runs", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("share", 8).alias("share"))
)
query("runtime_ranks", "SELECT user_id AS query, event_type AS method, value AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type)::INTEGER AS rank FROM events")(
    lambda spark, d: estimators.runtime_ranks(tables(spark, d)["events"].select(F.col("user_id").alias("query"), F.col("event_type").alias("method"), F.col("value").alias("seconds")))
)

# --- full joins along a tree of foreign keys

_TREE = [ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]
_OUTER = "customer FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON o_custkey = c_custkey FULL OUTER JOIN (SELECT * FROM lineitem WHERE l_quantity < 40) l ON l_orderkey = o_orderkey"


def _partial(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = tables(spark, d)
    return {"customer": t["customer"], "orders": t["orders"].where("o_orderkey % 7 <> 0"), "lineitem": t["lineitem"].where("l_quantity < 40")}


query("full_outer_tree", f"SELECT count(*)::BIGINT AS rows, count(c_custkey)::BIGINT AS customers, count(o_orderkey)::BIGINT AS orders, count(l_orderkey)::BIGINT AS items FROM {_OUTER}")(
    lambda spark, d: exact.full_outer_tree(_partial(spark, d), _TREE, "customer", {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"]}).agg(
        F.count("*").alias("rows"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count("l_orderkey").alias("items")
    )
)
query("full_join_size", f"SELECT count(*)::BIGINT AS rows FROM {_OUTER}")(lambda spark, d: _frame(spark, [(exact.full_join_size(_partial(spark, d), _TREE, "customer"),)], "rows long"))

# --- networks

_NETS = {
    "one column": "SELECT * FROM orders AS o WHERE o.o_orderstatus = 'F'",
    "in and range": "SELECT * FROM orders AS o WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND o.o_totalprice < 100000",
    "between and not": "SELECT * FROM orders AS o WHERE o.o_totalprice BETWEEN 50000 AND 150000 AND o.o_orderstatus != 'P'",
}


def _near(estimate: float, truth: float, ratio: float) -> bool:
    e, t = max(1.0, estimate), max(1.0, float(truth))
    return bool(max(e / t, t / e) <= ratio)


@query("network_estimates", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS tree, TRUE AS independent, TRUE AS sampled, TRUE AS progressive, TRUE AS eliminated FROM {q.split(' FROM ', 1)[1]}" for n, q in _NETS.items()))
def network_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Whether tree network, independence, sampling, progressive sampling and variable elimination are within a fifth of the exact size."""
    t, rows = tables(spark, d)["orders"], []
    net = bayes.Network.fit(t, ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    for n, sql in _NETS.items():
        q = parse_one(sql)
        truth = exact.count({"orders": t}, q)
        whole = eliminate(net.factors(), sorted(net.parent)).values
        for i, c in enumerate(sorted(net.parent)):
            whole = whole * net.codings[c].weights([p for p in q.predicates if p.column == c]).reshape([-1 if k == i else 1 for k in range(whole.ndim)])
        made = (net.cardinality(q.predicates), net.independent(q.predicates), net.rows * net.sampled_probability(q.predicates), net.rows * net.progressive_probability(q.predicates), net.rows * whole.sum())
        rows.append((n, truth, *(_near(x, truth, 1.2) for x in made)))
    return _frame(spark, rows, "query string, truth long, tree boolean, independent boolean, sampled boolean, progressive boolean, eliminated boolean")


_ONE = "SELECT count(*)::BIGINT AS {0} FROM orders WHERE o_orderstatus = 'F'"


@query("network_kept_up", "SELECT count(*)::BIGINT AS updated, count(*)::BIGINT AS loaded FROM orders WHERE o_orderstatus = 'F'")
def network_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """The size by a network fitted on a part and brought up to date with the rest, and by the same network written and read; exact, as every value has a code."""
    first, rest = prepare.split(tables(spark, d)["orders"], "o_orderkey", 0.5)
    net = bayes.Network.fit(first, ["o_orderstatus", "o_orderpriority"])
    net.update(rest)
    path = _folder(spark)
    bayes.save_network(spark, net, path)
    p = parse_one("SELECT * FROM orders AS o WHERE o.o_orderstatus = 'F'").predicates
    return _frame(spark, [(round(net.cardinality(p)), round(bayes.load_network(spark, path).cardinality(p)))], "updated long, loaded long")


_STATUS = "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::BIGINT AS n FROM orders GROUP BY ALL"


@query("factor_marginals", f"WITH t AS ({_STATUS}) SELECT 'a' AS side, a AS state, round(sum(n) / (SELECT sum(n) FROM t), 9) AS p, round(sum(n) / (SELECT sum(n) FROM t), 9) AS calibrated, round(max(n) / sum(max(n)) OVER (), 9) AS most, a = (SELECT a FROM t ORDER BY n DESC, a, b LIMIT 1) AS best FROM t GROUP BY a")
def factor_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Marginals by elimination and by messages, max-marginals, and the most probable states, of a table of counts."""
    found = {(r["o_orderstatus"], r["o_orderpriority"]): r["n"] for r in bayes.contingency(tables(spark, d)["orders"], "o_orderstatus", ["o_orderpriority"]).collect()}
    a, b = sorted({x for x, _ in found}), sorted({y for _, y in found})
    f = Factor(("a", "b"), np.array([[float(found.get((x, y), 0)) for y in b] for x in a]))
    p, most, both = eliminate([f], ["a"]).values, eliminate([f], ["a"], how="max").values, calibrate([f])["a"]
    best = most_probable([f], ["a", "b"])
    return _frame(spark, [("a", x, round(float(p[i]), 9), round(float(both[i]), 9), round(float(most[i]), 9), i == best["a"]) for i, x in enumerate(a)], "side string, state string, p double, calibrated double, most double, best boolean")


_ENSEMBLE = {
    "two": "SELECT * FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'",
    "three": "SELECT * FROM lineitem AS l, orders AS o, customer AS c WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_returnflag = 'R' AND c.c_mktsegment = 'BUILDING'",
}


@query("ensemble_estimates", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*)::BIGINT AS truth, TRUE AS near FROM {q.split(' FROM ', 1)[1]}" for n, q in _ENSEMBLE.items()))
def ensemble_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Whether networks over foreign keys give join sizes within a quarter of the truth."""
    t = {n: x for n, x in tables(spark, d).items() if n in ("customer", "orders", "lineitem")}
    made = ensemble.Ensemble.fit(t, STAR, {"customer": ("c_mktsegment",), "orders": ("o_orderstatus",), "lineitem": ("l_returnflag",)})
    rows = []
    for n, sql in _ENSEMBLE.items():
        truth = exact.count(t, parse_one(sql))
        rows.append((n, truth, _near(made.cardinality(parse_one(sql)), truth, 1.25)))
    return _frame(spark, rows, "query string, truth long, near boolean")


@query("spn_estimates", "SELECT l_returnflag AS flag, count(*)::BIGINT AS truth, round(sum(l_discount), 4) AS true_sum, TRUE AS count_near, TRUE AS sum_near, TRUE AS average_near FROM lineitem WHERE l_quantity < 20 GROUP BY l_returnflag")
def spn_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Whether counts, sums and averages from a sum-product network are within a tenth of the exact ones, for each of its groups."""
    t, rows = tables(spark, d)["lineitem"], []
    net = SumProductNetwork.fit(t, ["l_quantity", "l_discount", "l_returnflag"])
    truth = {r[0]: r for r in t.where("l_quantity < 20").groupBy("l_returnflag").agg(F.count("*"), F.sum("l_discount"), F.avg("l_discount")).collect()}
    for flag in net.groups("l_returnflag"):
        p = parse_one(f"SELECT * FROM lineitem AS l WHERE l.l_returnflag = '{flag}' AND l.l_quantity < 20").predicates
        _, n, s, a = truth[flag]
        rows.append((flag, n, round(s, 4), _near(net.count(p), n, 1.1), bool(abs(net.sum("l_discount", p) - s) <= 0.1 * s), bool(abs(net.average("l_discount", p) - a) <= 0.1 * a)))
    return _frame(spark, rows, "flag string, truth long, true_sum double, count_near boolean, sum_near boolean, average_near boolean")


@query("aqp_sampled", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity)::DOUBLE, 2) AS truth, TRUE AS inside, TRUE AS near FROM lineitem GROUP BY ALL")
def aqp_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Sums from a sample of a fifth of the orders: whether the truth lies within twice the 90 per cent interval, and within a fifth."""
    a = parse_aggregate(AGGREGATES["sum"])
    about = aggregates.approximate(tables(spark, d), a, "l", "l_orderkey", 0.2).withColumnRenamed("value", "estimate")
    truth = aggregates.evaluate(tables(spark, d), a).withColumnRenamed("value", "truth")
    both = truth.join(about, ["l_returnflag", "l_linestatus"], "left")
    off = F.abs(F.col("truth") - F.col("estimate"))
    return both.select("l_returnflag", "l_linestatus", F.round("truth", 2).alias("truth"), F.coalesce(off <= F.col("high") - F.col("low"), F.lit(False)).alias("inside"), F.coalesce(off <= 0.2 * F.col("truth"), F.lit(False)).alias("near"))


@query("q_error_summary", "SELECT * FROM " + _values("('scan', TRUE)", "('statistics', TRUE)") + " AS v(method, near)")
def q_error_summary(spark: SparkSession, d: str) -> DataFrame:
    """Whether half of some bounds, from scans and from statistics, are within eight times the truth."""
    few = [parse_one(JOINS[k]) for k in ("two_tables", "chain", "star", "key_filter", "disjunction")]
    t, stats, rows, scanned = tables(spark, d), core_statistics(spark, d, few), [], {}
    for q in few:
        truth = exact.count(t, q)
        rows += [("statistics", bound.bound(stats, q), truth), ("scan", bound.scanned_bound(t, q, scanned), truth)]
    made = estimators.q_errors(_frame(spark, rows, "method string, estimate double, truth long"))
    return made.select("method", ((F.col("q50") >= 1) & (F.col("q50") <= 8)).alias("near"))


query("covariances", "SELECT 'l_discount' AS a, 'l_discount' AS b, round(var_samp(l_discount), 8) AS cov, 1.0::DOUBLE AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', round(covar_samp(l_discount, l_extendedprice), 4), round(corr(l_discount, l_extendedprice), 7) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(var_samp(l_extendedprice), 0), 1.0 FROM lineitem")(
    lambda spark, d: bayes.covariances(tables(spark, d)["lineitem"], ["l_discount", "l_extendedprice"]).select(
        "a", "b", F.when(F.col("b") == "l_discount", F.round("cov", 8)).when(F.col("a") == "l_discount", F.round("cov", 4)).otherwise(F.round("cov", 0)).alias("cov"), F.round("r", 7).alias("r")
    )
)
query("conditional_table_grid", "WITH b AS (SELECT p_brand a, p_size b, count(*)::DOUBLE n FROM part GROUP BY ALL), g AS (SELECT a.a, b.b, coalesce(n, 0) + 0.5 AS n FROM (SELECT DISTINCT a FROM b) a CROSS JOIN (SELECT DISTINCT b FROM b) b LEFT JOIN b c ON c.a = a.a AND c.b = b.b) SELECT a AS p_brand, b AS p_size, round(n / sum(n) OVER (PARTITION BY b), 9) AS p FROM g")(
    lambda spark, d: bayes.conditional_table(tables(spark, d)["part"], "p_brand", "p_size", 0.5).withColumn("p", F.round("p", 9))
)


@query("attribute_kinds", "SELECT c AS \"column\", CASE WHEN n = 2 THEN 'boolean' WHEN number AND (n >= rows / 20 OR n > 3000) THEN 'continuous' ELSE 'categorical' END AS kind FROM (SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_totalprice) AS t, count(DISTINCT o_orderpriority) AS p FROM orders) o, LATERAL (VALUES ('o_orderstatus', o.s, FALSE), ('o_totalprice', o.t, TRUE), ('o_orderpriority', o.p, FALSE)) AS v(c, n, number)")
def attribute_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, sorted(bayes.attribute_kinds(tables(spark, d)["orders"], ["o_orderstatus", "o_totalprice", "o_orderpriority"]).items()), "column string, kind string")


# --- preparation

@query("prepared_columns", "SELECT (count(*) - count(o_orderkey))::BIGINT AS sentinels, (max(o_orderkey) + 1)::BIGINT AS sentinel, count(*)::BIGINT AS rows, (SELECT count(*) FROM nation WHERE n_regionkey = 2)::BIGINT AS rewritten, TRUE AS dependent FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def prepared_columns(spark: SparkSession, d: str) -> DataFrame:
    """Nulls as a value above all, rows of two parts that a hash makes, and a predicate on a dependent column put on its determinant."""
    t = tables(spark, d)
    rows = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    filled, sentinel = prepare.fill_nulls(rows, "o_orderkey")
    a, b = prepare.split(rows, "c_custkey", 0.3)
    pairs = {r[0]: r[1] for r in prepare.dependency(t["nation"], "n_nationkey", "n_regionkey").collect()}
    q = parse_one("SELECT * FROM nation AS n WHERE n.n_regionkey = 2")
    p = prepare.rewrite_dependent(q.predicates[0], "n_nationkey", pairs)
    found = t["nation"].where(exact.predicate_column(t["nation"], p)).count()
    return _frame(spark, [(filled.where(F.col("o_orderkey") == sentinel).count(), int(sentinel), a.count() + b.count(), found, prepare.is_dependent(t["nation"], "n_nationkey", "n_regionkey"))], "sentinels long, sentinel long, rows long, rewritten long, dependent boolean")


query("partial_correlation", "SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r FROM (SELECT corr(l_quantity, l_extendedprice) ab, corr(l_quantity, l_discount) ac, corr(l_extendedprice, l_discount) bc FROM lineitem)")(
    lambda spark, d: _frame(spark, [(round(prepare.partial_correlation(tables(spark, d)["lineitem"], "l_quantity", "l_extendedprice", ["l_discount"]), 6),)], "r double")
)


@query("random_joins", "SELECT 5::BIGINT AS joins, TRUE AS connected, TRUE AS known")
def random_joins(spark: SparkSession, d: str) -> DataFrame:
    """Joins drawn from the foreign keys: connected, and along declared keys alone."""
    made = [prepare.random_join(STAR, 4, seed) for seed in range(5)]
    keys = {(fk.table, fk.column, fk.key_table, fk.key_column) for fk in STAR.foreign_keys}
    known = all((q.tables[a], x, q.tables[b], y) in keys or (q.tables[b], y, q.tables[a], x) in keys for q in made for j in q.joins for (a, x), (b, y) in [(j.left, j.right)])
    return _frame(spark, [(len(made), all(len(q.parts()) == 1 and len(q.tables) == 4 for q in made), known)], "joins long, connected boolean, known boolean")


query("stripped", "SELECT p_partkey, p_name AS name FROM part")(lambda spark, d: tables(spark, d)["part"].select("p_partkey", stripped(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n  "))).alias("name")))

# --- query graphs and text

_ROUND = ("star", "cyclic", "like_filter", "disjunction")


@query("query_text", " UNION ALL ".join(f"SELECT '{n}' AS query, n FROM ({_count_sql(JOINS[n])})" for n in _ROUND))
def query_text(spark: SparkSession, d: str) -> DataFrame:
    """What Spark counts when it is given the SQL that a query prints."""
    sources.as_views({f"printed_{n}": t for n, t in tables(spark, d).items()})
    out = None
    for n in _ROUND:
        q = parse_one(JOINS[n])
        for a in q.tables:
            q.tables[a] = f"printed_{q.tables[a]}"
        one = spark.sql(q.count_sql()).toDF("n").select(F.lit(n).alias("query"), "n")
        out = one if out is None else out.union(one)
    return out


query("query_generations", "SELECT * FROM " + _values("('l', 0::BIGINT)", "('o', 1)", "('c', 2)", "('n', 3)", "('r', 4)") + " AS v(alias, generation)")(
    lambda spark, d: _frame(spark, sorted(parse_one(JOINS["snowflake"]).generations("l").items()), "alias string, generation long")
)
query("query_described", "SELECT 5::BIGINT AS named, TRUE AS joins")(
    lambda spark, d: _frame(spark, [(sum(f"{a}" in parse_one(JOINS["snowflake"]).describe() for a in parse_one(JOINS["snowflake"]).tables), all(c in parse_one(JOINS["snowflake"]).describe() for c in ("l_orderkey", "o_custkey", "n_regionkey")))], "named long, joins boolean")
)

# --- readers and writers


def _written(spark: SparkSession, df: DataFrame, path: str, **options) -> str:
    df.write.csv(path, **options)
    return path


@query("read_pipes", "SELECT count(*)::BIGINT AS rows, sum(n_nationkey)::BIGINT AS keys, sum(length(n_name))::BIGINT AS letters, count(*)::BIGINT AS other_rows FROM nation")
def read_pipes(spark: SparkSession, d: str) -> DataFrame:
    """Files with pipes between and after the fields, with known columns and with given ones."""
    path = _folder(spark)
    rows = tables(spark, d)["nation"].select("n_nationkey", "n_name", "n_regionkey", F.lit("no comment").alias("c"), F.lit(None).cast("string").alias("end"))
    _written(spark, rows, f"{path}/nation.tbl", sep="|")
    _written(spark, rows.drop("c"), f"{path}/nation.dat", sep="|")
    made = sources.read_tpch(spark, path, ["nation"])["nation"]
    other = sources.read_tpcds(spark, path, {"nation": "n_nationkey int, n_name string, n_regionkey int"})["nation"].where("n_regionkey is not null").count()
    return made.agg(F.count("*").alias("rows"), F.sum("n_nationkey").alias("keys"), F.sum(F.length("n_name")).cast("long").alias("letters"), F.lit(other).cast("long").alias("other_rows"))


@query("read_csv_layouts", "SELECT (SELECT count(*) FROM customer)::BIGINT AS users, (SELECT sum(c_custkey) FROM customer)::BIGINT AS ids, (SELECT count(*) FROM part)::BIGINT AS titles, (SELECT sum(length(p_name) + 7) FROM part)::BIGINT AS letters")
def read_csv_layouts(spark: SparkSession, d: str) -> DataFrame:
    """CSV with a header; and without, with quotes and commas in the fields."""
    t, path = tables(spark, d), _folder(spark)
    none = F.lit(None)
    _written(spark, t["customer"].select(F.col("c_custkey").cast("int").alias("Id"), F.col("c_nationkey").alias("Reputation"), F.lit("2014-01-01 00:00:00").alias("CreationDate"), F.lit(1).alias("Views"), F.lit(2).alias("UpVotes"), F.lit(3).alias("DownVotes")), f"{path}/users.csv", header=True)
    title = [F.col("p_partkey").cast("int").alias("id"), F.concat(F.lit('a "b", '), "p_name").alias("title"), none.cast("string").alias("i"), F.lit(1).alias("k"), F.lit(1999).alias("y"), *(none.cast("string").alias(f"x{j}") for j in range(7))]
    _written(spark, t["part"].select(*title), f"{path}/title.csv", quote='"', escape="\\")
    users, titles = sources.read_stats(spark, path, ["users"])["users"], sources.read_imdb(spark, path, ["title"])["title"]
    u, x = users.agg(F.count("CreationDate"), F.sum("Id")).first(), titles.agg(F.count("*"), F.sum(F.length("title"))).first()
    return _frame(spark, [(u[0], u[1], x[0], x[1])], "users long, ids long, titles long, letters long")


@query("read_renamed", "SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE o_orderkey % 2 = 0)::BIGINT AS numbers, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 2) AS total, 2::BIGINT AS columns FROM orders")
def read_renamed(spark: SparkSession, d: str) -> DataFrame:
    """CSV columns dropped, renamed, and read as numbers where they are numbers."""
    path = _folder(spark)
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("none"))
    _written(spark, tables(spark, d)["orders"].select("o_orderkey", price.alias("price"), "o_orderpriority"), path, header=True)
    made = sources.read_renamed_csv(spark, path, "orders", ["o_orderpriority"], ["price"])
    return made.agg(F.count("*").alias("rows"), F.count("`orders.price`").alias("numbers"), F.round(F.sum("`orders.price`"), 2).alias("total"), F.lit(len(made.columns)).cast("long").alias("columns"))


@query("read_ddl", "SELECT count(*)::BIGINT AS rows, sum(n_nationkey)::BIGINT AS keys, sum(length(n_name))::BIGINT AS letters FROM nation")
def read_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Tables declared by CREATE TABLE and filled by COPY."""
    path = _folder(spark)
    _written(spark, tables(spark, d)["nation"].select("n_nationkey", "n_name", "n_regionkey"), f"{path}/nation.csv", sep=";", header=True)
    text = "CREATE TABLE nation (\n  n_nationkey integer NOT NULL PRIMARY KEY,\n  n_name character varying(25),\n  n_regionkey integer REFERENCES region (r_regionkey),\n  PRIMARY KEY (n_nationkey)\n);\nCOPY nation FROM 'nation.csv' CSV HEADER DELIMITER ';';"
    return sources.load_ddl(spark, text, path)["nation"].agg(F.count("*").alias("rows"), F.sum("n_nationkey").alias("keys"), F.sum(F.length("n_name")).cast("long").alias("letters"))


@query("read_workload", " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, n, n AS listed FROM ({_count_sql(JOINS[k])})" for i, k in enumerate(("two_tables", "key_filter", "disjunction"))))
def read_workload(spark: SparkSession, d: str) -> DataFrame:
    """Queries read from a file, counted, and their sizes written, and read back from a file of results."""
    path, t = _folder(spark), tables(spark, d)
    text = "-- some queries\n" + "\n".join(f"{JOINS[k]};" for k in ("two_tables", "key_filter", "disjunction"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/queries")
    found = sources.read_queries(f"{path}/queries", spark=spark)
    counts = [exact.count(t, q) for q in found]
    spark.createDataFrame([("\n".join(f"{q.sql()}#{n}" for q, n in zip(found, counts, strict=True)),)], "value string").coalesce(1).write.text(f"{path}/results")
    listed = sources.read_results(f"{path}/results", spark)
    sources.write_results(_frame(spark, [(i, n, x) for i, (n, x) in enumerate(zip(counts, listed, strict=True))], "i long, n long, listed long"), f"{path}/table")
    return spark.read.csv(f"{path}/table", header=True, schema="i long, n long, listed long")


@query("write_sampled", "SELECT count(*)::BIGINT AS whole, TRUE AS fewer FROM customer")
def write_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Tables written whole if they are small, else as a hash sample of about the size asked for."""
    t, path = tables(spark, d)["customer"], _folder(spark)
    n = t.count()
    sources.write_sampled(t, f"{path}/whole", "c_custkey", n)
    sources.write_sampled(t, f"{path}/part", "c_custkey", n // 2)
    part = spark.read.parquet(f"{path}/part").count()
    return _frame(spark, [(spark.read.parquet(f"{path}/whole").count(), bool(0.3 * n < part < 0.7 * n))], "whole long, fewer boolean")


