"""Statistics are built for what queries look up, and for no more."""

import pytest
from pyspark.sql import functions as F

from rowceil import further_queries, queries
from rowceil.model import ForeignKey, Schema, TableSpec
from rowceil.operators import exact, statistics
from rowceil.plans import bound, planner
from rowceil.plans.parser import parse_one

FEW = statistics.Options(buckets=4, common_values=4, groups=4, common_grams=4)
#: For each join, the columns that its plan may read.
READ = {
    "parts": {"region": ("r_name",), "nation": ("n_nationkey",), "supplier": ("s_nationkey",)},
    "disjunction": {"orders": ("o_custkey",), "customer": ("c_custkey", "c_mktsegment", "c_acctbal")},
    "star": {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "part": ("p_partkey", "p_size"), "supplier": ("s_suppkey", "s_acctbal"), "orders": ("o_orderkey",)},
    "snowflake": {"lineitem": ("l_orderkey",), "orders": ("o_orderkey", "o_custkey", "o_orderdate"), "customer": ("c_custkey", "c_nationkey"), "nation": ("n_nationkey", "n_regionkey"), "region": ("r_regionkey", "r_name")},
}


def guarded(tables, read):
    """The tables, with columns that fail when they are read wherever `read` doesn't name them."""
    fails = lambda t, df, c: F.raise_error(F.lit(f"read {t}.{c}")).cast(df.schema[c].dataType).alias(c)
    return {t: df.select(*(F.col(c) if c in read.get(t, ()) else fails(t, df, c) for c in df.columns)) for t, df in tables.items()}


@pytest.mark.parametrize("name", READ)
def test_a_planned_join_reads_the_columns_it_names(spark, sf_dir, monkeypatch, name):
    whole = queries.tables(spark, sf_dir)
    monkeypatch.setattr(queries, "tables", lambda *_: guarded(whole, READ[name]))
    monkeypatch.setattr(queries, "_built", {})
    assert queries.MADE[f"planned_join_{name}"](spark, sf_dir).first()["n"] == exact.count(whole, parse_one(queries.JOINS[name]))


def test_a_summary_of_errors_reads_the_columns_its_joins_name(spark, sf_dir, monkeypatch):
    whole = queries.tables(spark, sf_dir)
    read = {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), "orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), "part": ("p_partkey", "p_brand", "p_size"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal")}
    monkeypatch.setattr(further_queries, "tables", lambda *_: guarded(whole, read))
    monkeypatch.setattr(queries, "tables", lambda *_: guarded(whole, read))
    monkeypatch.setattr(queries, "_built", {})
    assert sorted(tuple(r) for r in queries.MADE["q_error_summary"](spark, sf_dir).collect()) == [("scan", True), ("statistics", True)]


def test_a_random_workload_reads_no_tables_but_its_own(spark, sf_dir, monkeypatch):
    whole = queries.tables(spark, sf_dir)
    read = {n: (*queries.CORE.tables[n].join_columns, *queries.CORE.tables[n].filter_columns) for n in ("orders", "customer", "part", "lineitem")}
    monkeypatch.setattr(further_queries, "tables", lambda *_: guarded(whole, read))
    monkeypatch.setattr(queries, "tables", lambda *_: guarded(whole, read))
    monkeypatch.setattr(queries, "_built", {})
    assert tuple(queries.MADE["random_workload"](spark, sf_dir).first()) == (12, True)


def test_needed_statistics_are_those_of_whole_ones(spark, sf_dir):
    t = queries.tables(spark, sf_dir)
    q = parse_one("SELECT * FROM orders AS o, customer AS c, nation AS n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND o.o_orderkey > 0 AND (c.c_mktsegment = 'BUILDING' OR c.c_acctbal < 0) AND n.n_name LIKE '%IA%' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')")
    need = bound.needs(queries.CORE, [q])
    assert need["customer"] == statistics.Need(frozenset(("c_custkey", "c_nationkey")), frozenset({("c_mktsegment",), ("c_acctbal",), ("c_nationkey", "nation", "n_name")}))
    assert need["orders"] == statistics.Need(frozenset(("o_custkey",)), frozenset({("o_orderkey",), ("o_orderpriority",), ("o_custkey", "customer", "c_mktsegment"), ("o_custkey", "customer", "c_acctbal")}))
    every = {n: statistics.Need(frozenset(queries.CORE.tables[n].join_columns), x.filters) for n, x in need.items()}
    whole, same, least = (statistics.build(t, queries.CORE, FEW, set(need), needs=x) for x in (None, every, need))
    assert bound.bound(same, q) == bound.bound(whole, q) and planner.plan(same, q, t) == planner.plan(whole, q, t)
    assert set(least.tables) == set(need) and set(least.tables["orders"].full) == {"o_custkey", statistics.ROWS}
    assert exact.count(t, q) <= bound.bound(least, q) * (1 + 1e-9) <= 1.5 * bound.bound(whole, q)


def test_what_was_built_serves_queries_that_need_less(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "_built", {})
    some, less, more = (parse_one(f"SELECT * FROM {x}") for x in ("nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'", "region AS r WHERE r.r_name = 'ASIA'", "nation AS n WHERE n.n_name = 'x'"))
    first = queries.core_statistics(spark, sf_dir, [some])
    assert queries.core_statistics(spark, sf_dir, [less]) is first
    assert queries.core_statistics(spark, sf_dir, [more]) is not first
    assert bound.bound(queries.core_statistics(spark, sf_dir, [less]), less) >= 1


def test_keys_that_refer_to_nothing_are_in_a_tables_own_degrees(spark):
    """Rows are counted by key once, for a foreign key's filters and for the degrees of all rows."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    facts = spark.range(600).selectExpr("if(id % 10 = 0, null, id % 7) AS k", "id % 5 AS s").mapInArrow(seen, "k long, s long")
    keys = spark.range(4).selectExpr("id", "concat('v', id % 2) AS v")
    schema = Schema.of([TableSpec("f", ("k", "s")), TableSpec("d", ("id",), ("v",))], [ForeignKey("f", "k", "d", "id")])
    made = statistics.build({"f": facts, "d": keys}, schema, FEW, {"f"}, {"f": statistics.Need(frozenset(("k",)), frozenset({("k", "d", "v")}))}).tables["f"]
    degrees = sorted((r["d"] for r in exact.degrees(spark.range(600).selectExpr("if(id % 10 = 0, null, id % 7) AS k"), "k").collect()), reverse=True)
    assert [round(float(made.full["k"].rows_at(i + 1))) for i in range(len(degrees))] == [sum(degrees[: i + 1]) for i in range(len(degrees))]
    assert round(made.full[statistics.ROWS].total) == 600
    assert round(made.filters["k", "d", "v"].not_null["k"].total) == sum(1 for i in range(600) if i % 10 and i % 7 < 4)
    assert reads.value == 2 * 600  # once for sizes, once for counts by key
