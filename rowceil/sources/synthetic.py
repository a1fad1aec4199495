"""Seeded synthetic tables and workloads."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Schema
from ..plans.query import Query


def columns(spark: SparkSession, rows: int, count: int, domain: int = 100, skew: float = 1.0, correlation: float = 0.0, seed: int = 1) -> DataFrame:
    """attr0.. of integers below domain: skew bends towards small values, and each column repeats the one before it in a share `correlation` of rows."""
    df = spark.range(rows)
    for i in range(count):
        own = F.floor(F.lit(domain) * F.pow(F.rand(seed + 2 * i), F.lit(skew))).cast("int")
        df = df.withColumn(f"attr{i}", own if i == 0 else F.when(F.rand(seed + 2 * i + 1) < correlation, F.col(f"attr{i - 1}")).otherwise(own))
    return df.drop("id")


def zipf_keys(spark: SparkSession, rows: int, keys: int, exponent: float = 1.0, seed: int = 1) -> DataFrame:
    """key: 1..keys, the k-th as frequent as k ** -exponent."""
    weights = [k**-exponent for k in range(1, keys + 1)]
    total, at, cuts = sum(weights), 0.0, []
    for w in weights:
        at += w / total
        cuts.append(at)
    u = F.rand(seed)
    return spark.range(rows).select(u.alias("u")).select((F.size(F.filter(F.array(*map(F.lit, cuts[:-1])), lambda c: c < F.col("u"))) + 1).alias("key"))


def example_tables(spark: SparkSession, seed: int = 1) -> dict[str, DataFrame]:
    """R(X), S(X, Y), T(Y, A): S.Y refers to T.Y."""
    r = spark.range(1000).select((F.floor(F.rand(seed) * 99) + 1).cast("int").alias("X"))
    s = spark.range(3000).select((F.floor(F.rand(seed + 1) * 99) + 1).cast("int").alias("X"), (F.floor(F.rand(seed + 2) * 999) + 1).cast("int").alias("Y"))
    t = spark.range(1000).select(F.col("id").cast("int").alias("Y"), (F.floor(F.rand(seed + 3) * 99) + 1).cast("int").alias("A"))
    return {"R": r, "S": s, "T": t}


def random_query(schema: Schema, values: dict[str, dict[str, Sequence]], rng: random.Random, tables: int = 3, predicates: int = 3) -> Query:
    """Tables connected by foreign keys, with predicates whose literals are values that occur.

    values: for each table and filter column some of its values.
    """
    start = rng.choice(sorted(t for t in schema.tables if t in values))
    q, inside = Query().add_alias(start), [start]
    while len(inside) < tables:
        ways = [fk for fk in schema.foreign_keys if (fk.table in inside) != (fk.key_table in inside) and {fk.table, fk.key_table} <= set(values)]
        if not ways:
            break
        fk = rng.choice(ways)
        new = fk.key_table if fk.table in inside else fk.table
        q.add_alias(new).add_join(fk.table, fk.column, fk.key_table, fk.key_column)
        inside.append(new)
    options = [(t, c) for t in inside for c in values[t] if values[t][c]]
    for t, c in rng.sample(options, min(predicates, len(options))):
        some = sorted(values[t][c])
        v = rng.choice(some)
        kinds = ["=", "<=", ">=", "IN", "BETWEEN", "!="] + (["LIKE"] if isinstance(v, str) else ["<", ">"])
        op = rng.choice(kinds)
        if op == "IN":
            q.add_predicate(t, c, op, tuple(rng.sample(some, min(3, len(some)))))
        elif op == "BETWEEN":
            q.add_predicate(t, c, op, tuple(sorted((v, rng.choice(some)))))
        elif op == "LIKE":
            a = rng.randrange(len(v)) if v else 0
            q.add_predicate(t, c, op, f"%{v[a : a + rng.randint(2, 5)]}%".replace("_", "\\_"))
        else:
            q.add_predicate(t, c, op, v)
    return q
