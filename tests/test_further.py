import os

import pytest
from pyspark.sql import functions as F

from rowceil.functions import bloom
from rowceil.model import ForeignKey
from rowceil.operators import bayes, estimators, exact, statistics
from rowceil.plans.parser import parse_one
from rowceil.sources import tables as sources


def test_declared_tables():
    text = """
    CREATE TABLE a (id integer NOT NULL PRIMARY KEY, name character varying(12) DEFAULT 'x', price numeric(10, 2), day timestamp without time zone, PRIMARY KEY (id));
    create table if not exists "b" ( k BIGINT, a_id int REFERENCES a (id), note text );
    """
    assert sources.read_ddl(text) == {"a": "id int, name string, price double, day timestamp", "b": "k bigint, a_id int, note string"}


@pytest.fixture(scope="module")
def family(spark):
    return {
        "c": spark.createDataFrame([(1,), (2,), (3,)], "c_id long"),
        "o": spark.createDataFrame([(10, 1), (11, 1), (12, 9), (13, None)], "o_id long, o_c long"),
        "l": spark.createDataFrame([(10,), (10,), (12,), (99,), (None,)], "l_o long"),
    }


def test_full_joins_along_a_tree(family):
    keys = [ForeignKey("o", "o_c", "c", "c_id"), ForeignKey("l", "l_o", "o", "o_id")]
    rows = exact.full_outer_tree(family, keys, "c", {"c": ["c_id"], "o": ["o_id", "o_c"], "l": ["l_o"]}).count()
    assert rows == exact.full_join_size(family, keys, "c") == 9
    none = {n: df.limit(0) for n, df in family.items()}
    assert exact.full_join_size(none, keys, "c") == 0


def test_unconnected_parts_are_multiplied(family):
    assert exact.count(family, parse_one("SELECT * FROM c AS x, l AS y, o AS z WHERE y.l_o = z.o_id")) == 9


def test_edges_without_repeats(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(i,) for i in range(2, 40)] + [(None,)], "v int")
    found = sorted(r.edge for r in exact.distinct_edges(df, "v", 10).collect())
    assert len(found) == len(set(found)) == 10 and 1 in found
    assert sorted(r.edge for r in exact.distinct_edges(df.where("v < 5"), "v", 10).collect()) == [1, 2, 3, 4]


def test_smoothed_tables_have_every_combination(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 2)], "x string, y int")
    got = {(r.x, r.y): r.p for r in bayes.conditional_table(df, "x", "y", 1.0).collect()}
    assert got == {("a", 1): 3 / 5, ("b", 1): 1 / 5, (None, 1): 1 / 5, ("a", 2): 1 / 5, ("b", 2): 2 / 5, (None, 2): 2 / 5}


def test_runtimes(spark):
    df = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("r", "a", 1.0), ("r", "b", 1.0)], "query string, method string, seconds double")
    assert {(r.query, r.method): r["rank"] for r in estimators.runtime_ranks(df).collect()} == {("q", "b"): 1, ("q", "a"): 2, ("r", "a"): 1, ("r", "b"): 2}
    assert {r.method: (r.runs, r.total, r.share) for r in estimators.runtime_summary(df).collect()} == {"a": (2, 3.0, 1.0), "b": (2, 2.0, 2 / 3)}


def test_filters_of_columns(spark):
    df = spark.range(500).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS k")
    known = bloom.build(df.where("k < 250"), "k", 1000)
    found = {r.k for r in bloom.members(df, "k", known).collect()}
    assert {k for k in range(250) if k % 10} <= found and None not in found and len(found) < 250


def test_one_zero_and_text_of_values(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 1), (0.1, 2), (None, 2)], "f double, k int")
    (found,) = statistics.filter_statistics(df, ("k",), ("f",), statistics.Options(common_values=5))
    assert set(found.common) == {0.0, 0.1} and found.equal(0.0)["k"].total >= 2 and found.null["k"].total == 1


def test_largest_degrees_by_rank(spark):
    rows = [("v", f"k{i}", n) for i, n in enumerate((5, 3, 3))] + [("w", f"k{i}", n) for i, n in enumerate((4, 4, 1, 1))]
    df = spark.createDataFrame([("c", k, v, n) for v, k, n in rows], "column string, key string, value string, n long")
    got = {r.d: r.n for r in statistics.rank_maximum(df, "value").collect()}
    assert got == {5: 1, 4: 1, 3: 1, 1: 1}


def test_bloom_filters_of_more_keys_than_a_fixed_size_holds(spark, sf_dir, tmp_path):
    from rowceil import further_queries

    for name in os.listdir(sf_dir):
        if name != "orders.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(1).drop("o_custkey", "o_orderpriority")
    priority = F.when(F.col("o_custkey") % 4 == 0, "2-HIGH").otherwise("1-URGENT")
    orders.crossJoin(spark.range(400_000).withColumnRenamed("id", "o_custkey")).withColumn("o_orderpriority", priority).write.parquet(str(tmp_path / "orders.parquet"))
    assert further_queries.bloom_filters(spark, str(tmp_path)).first() == (300_000, 400_000, 0, True, True, True)


def test_joins_are_counted_without_making_their_rows(spark):
    hot = {"a": spark.range(20_000).selectExpr("0L AS a_k", "id AS a_i"), "b": spark.range(20_000).selectExpr("0L AS b_k"), "c": spark.range(20_000).selectExpr("0L AS c_k")}
    assert exact.count(hot, parse_one("SELECT * FROM a AS x, b AS y, c AS z WHERE x.a_k = y.b_k AND y.b_k = z.c_k AND x.a_i < 10000")) == 10_000 * 20_000**2
    ring = {"a": spark.range(3000).selectExpr("id % 100 AS a_1", "id % 7 AS a_2"), "b": spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 7) AS b_1", "id % 50 AS b_2"), "c": spark.range(300).selectExpr("id % 50 AS c_1", "id % 100 AS c_2", "id AS c_3")}
    q = parse_one("SELECT * FROM a AS x, b AS y, c AS z WHERE x.a_2 = y.b_1 AND y.b_2 = z.c_1 AND z.c_2 = x.a_1")
    truth = exact.joined(ring, q).count()
    assert truth > 0
    for order in (None, "xyz", "zyx", "yzx"):
        assert exact.count(ring, q, order) == truth
    q = parse_one("SELECT * FROM a AS x, a AS v, b AS y, c AS z, c AS w WHERE x.a_2 = y.b_1 AND v.a_1 = x.a_1 AND z.c_1 = z.c_2 AND w.c_1 < 3 AND w.c_2 = z.c_3")
    assert exact.count(ring, q) == exact.joined(ring, q.restricted("vxy")).count() * exact.joined(ring, q.restricted("zw")).count() > 0
