import random

import pytest
from pyspark.sql import functions as F

from rowceil.model import STAR, ForeignKey, Schema, TableSpec
from rowceil.operators import exact, statistics
from rowceil.plans import bound, planner
from rowceil.plans.parser import parse_one
from rowceil.sources import synthetic

FEW = statistics.Options(buckets=8, common_values=10, groups=6, common_grams=20)


@pytest.fixture(scope="module")
def star(spark):
    folder = "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet").cache() for n in ("customer", "orders", "lineitem", "part")}
    schema = Schema.of(
        [
            TableSpec("customer", ("c_custkey",), ("c_mktsegment", "c_acctbal")),
            TableSpec("part", ("p_partkey",), ("p_name", "p_size")),
            TableSpec("orders", ("o_orderkey", "o_custkey"), ("o_orderdate", "o_orderpriority")),
            TableSpec("lineitem", ("l_orderkey", "l_partkey"), ("l_quantity",)),
        ],
        [ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey")],
    )
    return t, schema, statistics.build(t, schema, FEW)


def test_random_queries_are_never_above_their_bound(star):
    t, schema, stats = star
    values = {n: {c: [r[0] for r in t[n].select(c).orderBy(F.xxhash64(c)).limit(25).collect()] for c in s.filter_columns} for n, s in schema.tables.items()}
    rng = random.Random(4)
    pandas = {n: df.toPandas() for n, df in t.items()}
    import duckdb

    con = duckdb.connect()
    for n, df in pandas.items():
        con.register(n, df)
    for _ in range(150):
        q = synthetic.random_query(schema, values, rng, rng.randint(1, 4), rng.randint(0, 4))
        truth = con.sql(q.count_sql().replace("\\_", "_")).fetchall()[0][0] if "\\_" not in q.sql() else 0
        b = bound.bound(stats, q)
        assert b * (1 + 1e-9) >= truth, q.sql()
        rows = con.sql(f"SELECT {' * '.join(f'(SELECT count(*) FROM {x})' for x in q.tables.values())}").fetchall()[0][0]
        assert b <= rows * (1 + 1e-9)


def test_saved_statistics_give_the_same_bounds(spark, star, tmp_path):
    t, schema, stats = star
    statistics.save(spark, stats, str(tmp_path))
    again = statistics.load(spark, str(tmp_path), schema, FEW)
    for sql in ("SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey AND p.p_name LIKE '%red%' AND p.p_size IN (1, 2, 3)", "SELECT * FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < '1995-06-01' AND c.c_acctbal > 0"):
        assert bound.bound(again, parse_one(sql)) == pytest.approx(bound.bound(stats, parse_one(sql)))
    assert again.memory() > 0


def test_planned_joins_keep_their_result(star):
    t, _, stats = star
    q = parse_one("SELECT * FROM lineitem AS l, orders AS o, customer AS c, part AS p WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_partkey = p.p_partkey AND c.c_mktsegment = 'BUILDING' AND p.p_size < 10")
    p = planner.plan(stats, q, t)
    assert sorted(p.order) == ["c", "l", "o", "p"] and len(p.hints) == len(q.connected_subsets(1)) and p.broadcast
    assert planner.planned(t, stats, q).count() == exact.count(t, q)
    assert planner.plan(stats, q, t, broadcast_bytes=0).broadcast == ()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i % 7 if i % 11 else None, None if i % 10 else f"v{i % 3}", ["abc", "abcd", "xyzabc", "ab", "", "ñandú", None, "zzq"][i % 8]) for i in range(400)]
    a = spark.createDataFrame(rows, "k int, f string, s string")
    b = spark.createDataFrame([(i % 5, i) for i in range(40)], "k int, v int")
    none = spark.createDataFrame([], "k int, f string, s string")
    schema = Schema.of([TableSpec("a", ("k",), ("f", "s")), TableSpec("b", ("k",), ("v",)), TableSpec("none", ("k",), ("f", "s"))])
    t = {"a": a, "b": b, "none": none}
    return t, statistics.build(t, schema, statistics.Options(buckets=4, common_values=2, groups=2, common_grams=2))


@pytest.mark.parametrize(
    "where",
    ["a.f IS NULL", "a.f IS NOT NULL", "a.f = 'v0'", "a.f = 'absent'", "a.f IN ('v0', 'v1', 'v0', 'none')", "a.f NOT IN ('v0')", "a.f != 'v1'", "a.s LIKE '%a%'", "a.s LIKE '%ab%'", "a.s LIKE 'a_c%'", "a.s LIKE '%'",
     "a.s LIKE '%abc%'", "a.s LIKE '%zzq%'", "a.s LIKE '%and%'", "a.s LIKE ''", "a.s = ''", "a.s < 'b'", "a.s >= ''", "a.s > 'a' AND a.s < 'b'", "a.s > 'x' AND a.s < 'b'", "a.s NOT LIKE '%abc%'", "(a.s = 'abc' OR a.f = 'v1')", "b.v BETWEEN 3 AND 9", "b.v = 3", "b.v > 1000", "b.v < 7 AND b.v > 2.5"],
)
def test_odd_values(odd, where):
    t, stats = odd
    q = parse_one(f"SELECT * FROM a, b WHERE a.k = b.k AND {where}")
    truth = exact.count(t, q)
    assert bound.bound(stats, q) * (1 + 1e-9) >= truth
    assert bound.scanned_bound(t, q) * (1 + 1e-9) >= truth
    q = parse_one(f"SELECT * FROM {where.lstrip('(')[0]} WHERE {where}")
    truth = exact.count(t, q)
    assert bound.bound(stats, q) * (1 + 1e-9) >= truth


def test_empty_tables_and_contradictions(odd):
    t, stats = odd
    for sql in ("SELECT * FROM none, b WHERE none.k = b.k", "SELECT * FROM none WHERE none.f = 'x'", "SELECT * FROM b WHERE b.v > 5 AND b.v < 3", "SELECT * FROM b WHERE b.v < -1"):
        assert exact.count(t, parse_one(sql)) == 0
    assert bound.bound(stats, parse_one("SELECT * FROM none, b WHERE none.k = b.k")) == 0
    assert bound.bound(stats, parse_one("SELECT * FROM b WHERE b.v > 5 AND b.v < 3")) == 0
    assert bound.bound(stats, parse_one("SELECT * FROM a, b")) == 16000


def test_known_bounds(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("supplier", "customer", "orders")}
    two = parse_one("SELECT * FROM supplier AS s, customer AS c WHERE s.s_nationkey = c.c_nationkey")
    assert bound.scanned_bound(t, two) == 6440 and bound.scanned_max_frequency_bound(t, two) == 7400 and exact.count(t, two) == 5949
    assert exact.star_bound([(t["supplier"], "s_nationkey"), (t["customer"], "c_nationkey")]).first()[0] == 6440
    assert STAR.keys_from("orders")[0].key_table == "customer"


def test_worked_example(spark):
    t = synthetic.example_tables(spark)
    schema = Schema.of([TableSpec("R", ("X",)), TableSpec("S", ("X", "Y")), TableSpec("T", ("Y",), ("A",))], [ForeignKey("S", "Y", "T", "Y")])
    stats = statistics.build(t, schema, FEW)
    q = parse_one("SELECT * FROM R AS r, S AS s, T AS t WHERE r.X = s.X AND s.Y = t.Y AND t.A < 20")
    truth, b = exact.count(t, q), bound.bound(stats, q)
    assert truth <= b <= 4 * truth


def test_buckets_that_need_no_sums_of_their_own():
    from rowceil.operators.statistics import _same_grams, interval_ends, interval_list

    for n in (1, 2, 7, 15, 20):
        edges = list(range(10, 10 + n))
        for name, first, last in interval_list(edges):
            if first <= last:
                low, high = interval_ends(name, edges)
                assert low == (edges[first - 1] if first else None) and high == (edges[last] if last < n else None)
    sets = {"all": frozenset("xyz"), "one": frozenset("y"), "two": frozenset("xy"), "both": frozenset("xy")}
    assert _same_grams([["one", "two", "all", "both"]], [["x", "y", "z"]], [sets], 1) == [{"one": "value 1", "all": "not null", "both": "gram 1"}]
