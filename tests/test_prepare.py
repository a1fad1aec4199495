import numpy as np
import pytest
from pyspark.sql import functions as F

from rowceil.model import STAR, ForeignKey, Schema, TableSpec
from rowceil.operators import exact, prepare
from rowceil.operators.ensemble import Ensemble
from rowceil.plans.parser import parse_one


def test_dependencies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, "a"), (None, "z")], "k int, v string")
    assert prepare.is_dependent(df, "k", "v") and not prepare.is_dependent(df, "v", "k")
    pairs = {r.k: r.v for r in prepare.dependency(df, "k", "v").collect()}
    p = prepare.rewrite_dependent(parse_one("SELECT * FROM t WHERE t.v = 'a'").predicates[0], "k", pairs)
    assert (p.column, p.op, p.value) == ("k", "IN", (1, 3))


def test_codes_nulls_and_splits(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] * 5 + [("a",)] * 3 + [(None,)], "v string")
    assert {r.value: r.code for r in prepare.categorical_codes(df, "v").collect()} == {"y": 0, "a": 1, "x": 2}
    filled, sentinel = prepare.fill_nulls(df, "v")
    assert filled.where(F.col("v") == sentinel).count() == 1
    n, top = prepare.fill_nulls(spark.createDataFrame([(5,), (None,)], "v int"), "v")
    assert top == 6 and n.where("v = 6").count() == 1
    a, b = prepare.split(spark.range(1000), "id", 0.3)
    assert a.count() + b.count() == 1000 and 200 < a.count() < 400


def test_independence(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 600)
    rows = [(int(a), int(a) if rng.random() < 0.5 else int(rng.integers(0, 3)), int(rng.integers(0, 3))) for a in x]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    t = np.zeros((3, 3))
    for a, b, _ in rows:
        t[a, b] += 1
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    r = prepare.chi_square(df, "a", "b").first()
    assert r.chi2 == pytest.approx(((t - e) ** 2 / e).sum()) and r.degrees == 4
    assert abs(prepare.partial_correlation(df, "a", "c", ["b"])) < 0.15 < prepare.partial_correlation(df, "a", "b", ["c"])


def test_random_joins_are_connected():
    for seed in range(10):
        q = prepare.random_join(STAR, 3, seed)
        assert len(q.parts()) == 1 and len(q.joins) == len(q.tables) - 1


def test_ensemble_of_networks(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("customer", "orders", "lineitem")}
    schema = Schema.of([TableSpec("customer", ("c_custkey",)), TableSpec("orders", ("o_orderkey", "o_custkey")), TableSpec("lineitem", ("l_orderkey",))], [ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")])
    e = Ensemble.fit(t, schema, {"customer": ["c_mktsegment"], "orders": ["o_orderpriority"], "lineitem": ["l_quantity"]})
    for where in ("c.c_mktsegment = 'BUILDING'", "o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND l.l_quantity < 20", "c.c_mktsegment != 'BUILDING' AND l.l_quantity >= 30"):
        q = parse_one(f"SELECT * FROM customer AS c, orders AS o, lineitem AS l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND {where}")
        truth = exact.count(t, q)
        assert truth / 1.5 <= e.cardinality(q) <= truth * 1.5
    with pytest.raises(ValueError):
        e.cardinality(parse_one("SELECT * FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_orderkey"))
