import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowceil.functions.bloom import BloomFilter
from rowceil.functions.factors import Factor, calibrate, eliminate, elimination_order, most_probable
from rowceil.functions.text import grams, like_matches, pattern_grams
from rowceil.operators import aggregates, bayes, estimators, exact
from rowceil.operators.spn import SumProductNetwork
from rowceil.plans.parser import parse_aggregate, parse_one
from rowceil.sources import synthetic, tables
from rowceil.streaming import incremental


@pytest.fixture(scope="module")
def rows(spark):
    return synthetic.columns(spark, 4000, 3, domain=12, skew=2.0, correlation=0.7, seed=3).cache()


def test_network_follows_correlation(spark, rows, tmp_path):
    net = bayes.Network.fit(rows, rows.columns)
    assert net.parent["attr1"] == "attr0" and net.parent["attr2"] == "attr1"
    p = parse_one("SELECT * FROM t WHERE t.attr0 < 3 AND t.attr1 < 3 AND t.attr2 IN (0, 1)").predicates
    truth = rows.where("attr0 < 3 and attr1 < 3 and attr2 in (0, 1)").count()
    assert net.cardinality(p) == pytest.approx(truth, rel=0.1)
    assert abs(net.independent(p) - truth) > abs(net.cardinality(p) - truth)
    assert net.rows * net.sampled_probability(p, 20000) == pytest.approx(net.cardinality(p), rel=0.1)
    assert net.rows * net.progressive_probability(p, 4000) == pytest.approx(net.cardinality(p), rel=0.1)
    bayes.save_network(spark, net, str(tmp_path))
    assert bayes.load_network(spark, str(tmp_path)).cardinality(p) == pytest.approx(net.cardinality(p))
    net.update(rows)
    assert net.cardinality(p) == pytest.approx(2 * truth, rel=0.1)
    assert bayes.attribute_kinds(rows, ["attr0"]) == {"attr0": "categorical"}


def test_fan_outs_undo_a_join(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "k int, g int")
    b = spark.createDataFrame([(i % 10,) for i in range(50)], "k int")
    mul = exact.fan_out(a, "k", b, "k").where("mul > 0")
    joined = mul.join(b.withColumnRenamed("k", "bk"), F.col("k") == F.col("bk"))
    net = bayes.Network.fit(joined, ["g", "mul"])
    p = parse_one("SELECT * FROM t WHERE t.g = 1").predicates
    assert net.join_cardinality(p, ["mul"]) == pytest.approx(a.where("g = 1 and k < 10").count(), rel=0.01)


def test_many_values_fall_into_intervals(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("x"))
    k = bayes.code_column(df, "x", common=5, bins=10)
    assert len(k.common) == 5 and len(k.edges) == 9
    net = bayes.Network.fit(df, ["x"], common=5, bins=10)
    p = parse_one("SELECT * FROM t WHERE t.x < 600").predicates
    assert net.cardinality(p) == pytest.approx(400, rel=0.05)


def test_factors_against_full_tables():
    rng = np.random.default_rng(1)
    f = [Factor(("a", "b"), rng.random((2, 3))), Factor(("b", "c"), rng.random((3, 4))), Factor(("c", "d"), rng.random((4, 2)))]
    full = np.einsum("ab,bc,cd->abcd", *(x.values for x in f))
    assert np.allclose(eliminate(f, ["a", "d"]).values, full.sum((1, 2)) / full.sum())
    assert np.allclose(eliminate(f, ["b"], {"d": 1}).values, full[..., 1].sum((0, 2)) / full[..., 1].sum())
    assert np.allclose(eliminate(f, ["a"], how="max").values, full.max((1, 2, 3)) / full.max((1, 2, 3)).sum())
    best = np.unravel_index(full.argmax(), full.shape)
    assert tuple(most_probable(f, ["a", "b", "c", "d"]).values()) == tuple(map(int, best))
    assert np.allclose(calibrate(f)["c"], full.sum((0, 1, 3)) / full.sum())
    for rule in ("min fill", "min neighbors", "min weight", "weighted min fill"):
        assert sorted(elimination_order(f, ["b", "c"], rule)) == ["b", "c"]
    g = f[0] * f[1]
    assert np.allclose((g / f[1]).marginalize(["c"]).values, 4 * f[0].values) and (f[0] + f[0]).values.sum() == pytest.approx(2 * f[0].values.sum())
    with pytest.raises(ValueError):
        Factor(("a", "a"), np.ones((2, 2)))


@settings(deadline=None, max_examples=50)
@given(st.lists(st.one_of(st.integers(), st.text(max_size=8)), max_size=60, unique=True), st.sampled_from([0.1, 0.01, 0.001]))
def test_bloom_has_no_false_negatives(items, error):
    a = BloomFilter(100, error)
    a.update(items)
    assert all(x in a for x in items) and BloomFilter.from_base64(a.to_base64()).bit_array == a.bit_array


def test_bloom_rates_and_set_operations():
    for error in (0.1, 0.01, 0.001):
        a = BloomFilter(1000, error)
        a.update(range(1000))
        assert sum(x in a for x in range(10_000, 30_000)) / 20_000 <= 2 * error
        assert abs(a.approx_len() - 1000) < 100 and a.num_hashes == len(a.hash_seeds)
    b = a.copy_template()
    b.update(range(500, 1500))
    assert all(x in (a | b) for x in range(1500)) and all(x in (a & b) for x in range(500, 1000))
    assert a.add(5) is True and a.copy().bit_count() == a.bit_count()
    a.clear_all()
    assert 5 not in a and len(a) == 0
    with pytest.raises(ValueError):
        a.union(BloomFilter(10, 0.1))


def test_grams(spark):
    df = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,), ("ñandú",)], "s string").select(grams(F.col("s")).alias("g"))
    assert [r.g for r in df.collect()] == [["abc", "bca", "cab"], [], [], None, ["ñan", "and", "ndú"]]
    assert pattern_grams("%abcd%e_fgh") == ["abc", "bcd", "fgh"] and pattern_grams("a\\%bc") == ["a%b", "%bc"]
    assert like_matches("a%b", "a\\%b") and like_matches("axb", "a_b") and not like_matches("ab", "a_b")


def test_aggregates_and_intervals(spark, rows):
    t = {"t": rows}
    a = parse_aggregate("SELECT SUM(attr1) FROM t WHERE t.attr0 > 2 GROUP BY t.attr2".replace("SELECT", "SELECT attr2,"))
    truth = {r[0]: r[1] for r in rows.where("attr0 > 2").groupBy("attr2").sum("attr1").collect()}
    assert {r["attr2"]: r["value"] for r in aggregates.evaluate(t, a).collect()} == pytest.approx(truth)
    keyed = {"t": rows.withColumn("id", F.monotonically_increasing_id())}
    got = aggregates.approximate(keyed, parse_aggregate("SELECT AVG(attr1) FROM t"), "t", "id", 0.3).first()
    mean = rows.agg(F.avg("attr1")).first()[0]
    assert got["low"] < got["high"] and abs(got["value"] - mean) < 4 * (got["high"] - got["low"])
    m, s = aggregates.interval_of_product([2.0, 3.0], [0.0, 0.0])
    assert (m, s) == (6.0, 0.0)


def test_sum_product_network(rows):
    net = SumProductNetwork.fit(rows, rows.columns)
    p = parse_one("SELECT * FROM t WHERE t.attr0 < 3").predicates
    e = rows.where("attr0 < 3").agg(F.count("*"), F.sum("attr1"), F.avg("attr1")).first()
    assert net.count(p) == pytest.approx(e[0], rel=0.02)
    assert net.sum("attr1", p) == pytest.approx(e[1], rel=0.25) and net.average("attr1", p) == pytest.approx(e[2], rel=0.25)
    assert net.deviation_of_average("attr1", p) > 0
    before = net.count(p)
    for _ in range(10):
        net.insert((1, 1, 1))
    assert net.count(p) > before + 8 and 1 in net.groups("attr0")


def test_samples_and_errors(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("customer", "orders")}
    q = parse_one("SELECT * FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
    s = estimators.correlated_samples(t, q, "c", "c_custkey", 0.2)
    keys = {r[0] for r in s["c"].select("c_custkey").collect()}
    assert {r[0] for r in s["o"].select("o_custkey").collect()} <= keys
    js, n = estimators.join_sample(t, q, "c", "c_custkey", 0.2, 10, [("c", "c_custkey"), ("o", "o_orderkey")])
    assert js.count() == 10 <= n
    est = estimators.sampled_estimate(t, q, 0.5, {"customer": "c_custkey", "orders": "o_orderkey"}, 1500)
    truth = exact.count(t, q)
    assert truth / 2 < est < truth * 2
    assert estimators.count_within(t, q, 60, -1) == (truth, True)
    bad = spark.createDataFrame([("m", 5.0, 10)], "method string, estimate double, truth long")
    assert estimators.violations(bad).count() == 1 and estimators.q_errors(bad).first()["q50"] == 2
    assert estimators.full_join_estimate([(3.0, 0.5)], 10) == 35


def test_stream_keeps_counts(spark, tmp_path):
    schema = "user_id long, v int"
    for i in range(2):
        spark.createDataFrame([(k % 5, k) for k in range(10 * (i + 1))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.maintain(stream, ["user_id"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.d, r.n) for r in incremental.current_runs(spark, str(tmp_path / "out"), "user_id").collect()} == {(6, 5)}
    incremental.merged(spark, str(tmp_path / "out"), str(tmp_path / "merged"))
    assert {(r.d, r.n) for r in incremental.current_runs(spark, str(tmp_path / "merged"), "user_id").collect()} == {(6, 5)}


def test_readers(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA|note|\n1|ASIA|x|\n")
    assert [tuple(r) for r in tables.read_tpch(spark, str(tmp_path), ["region"])["region"].collect()] == [(0, "AFRICA", "note"), (1, "ASIA", "x")]
    (tmp_path / "keyword.csv").write_text('1,"a \\"b\\", c",X1\n2,,\n')
    assert [tuple(r) for r in tables.read_imdb(spark, str(tmp_path), ["keyword"])["keyword"].collect()] == [(1, 'a "b", c', "X1"), (2, None, None)]
    (tmp_path / "tags.csv").write_text("Id,Count,ExcerptPostId\n1,5,\n")
    assert tables.read_stats(spark, str(tmp_path), ["tags"])["tags"].first()["Count"] == 5
    (tmp_path / "q.sql").write_text("SELECT * FROM a WHERE a.x = 1;\nSELECT * FROM b WHERE b.y < 2;")
    assert len(tables.read_queries(str(tmp_path / "q.sql"))) == 2 == len(tables.split_statements((tmp_path / "q.sql").read_text()))
    (tmp_path / "r.txt").write_text("a#b#12\nc#7\n")
    assert tables.read_results(str(tmp_path / "r.txt")) == [12, 7]
    (tmp_path / "c.csv").write_text("a,b,c\n1,x,2\nz,y,3\n")
    df = tables.read_renamed_csv(spark, str(tmp_path / "c.csv"), "t", ["c"], ["a"])
    assert df.columns == ["t.a", "t.b"] and [r[0] for r in df.collect()] == [1.0, None]
    tables.write_results(spark.range(3).toDF("n"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    assert synthetic.zipf_keys(spark, 2000, 10, 1.2).groupBy("key").count().orderBy(F.desc("count")).first()["key"] == 1


def test_network_counts_all_rows_of_few_combinations(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 7 as int) AS a", "cast((id div 7) % 5 as int) AS b", "substr('NNNNNNAR', cast(id % 8 as int) + 1, 1) AS flag")
    net = SumProductNetwork.fit(rows, rows.columns)  # more rows than a fit takes, 105 combinations
    assert net.groups("flag") == ["A", "N", "R"] and net.rows == 60_000
    for sql in ("flag = 'R'", "flag = 'A' AND t.a < 3", "b = 2"):
        true = rows.where(sql.replace("t.", "")).count()
        assert net.count(parse_one(f"SELECT * FROM t WHERE t.{sql}").predicates) == pytest.approx(true, rel=0.01)
    many = SumProductNetwork.fit(rows, rows.columns, sample=40)  # a priority sample of the combinations
    assert many.rows == 60_000 and many.count(parse_one("SELECT * FROM t WHERE t.flag = 'N'").predicates) == pytest.approx(45_000, rel=0.2)
