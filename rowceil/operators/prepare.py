"""Preparing tables for estimators: dependencies between columns, codes, null sentinels, splits, independence tests."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Schema
from ..plans.query import Predicate, Query
from .bayes import holds


def dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """determinant, dependent: the pairs that occur."""
    return df.where(F.col(determinant).isNotNull()).select(determinant, dependent).distinct()


def is_dependent(df: DataFrame, determinant: str, dependent: str) -> bool:
    """Whether each value of the determinant has one value of the dependent."""
    return dependency(df, determinant, dependent).groupBy(determinant).count().where("count > 1").isEmpty()


def rewrite_dependent(p: Predicate, determinant: str, pairs: Mapping[object, object]) -> Predicate:
    """A predicate on a dependent column as one on its determinant; pairs: dependent value by determinant value."""
    return Predicate(p.alias, determinant, "IN", tuple(k for k, v in sorted(pairs.items(), key=repr) if v is not None and holds(v, p)))


def categorical_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: codes from 0 by falling frequency, ties by value; null has none."""
    from .exact import distributed_ranks

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    keyed = counts.select(F.struct((-F.col("n")).alias("n"), "value").alias("key"))
    return distributed_ranks(keyed, "key").select(F.col("value.value").alias("value"), (F.col("last") - 1).alias("code"))


def fill_nulls(df: DataFrame, column: str) -> tuple[DataFrame, object]:
    """Nulls become a value that does not occur (a number above all, or a string); returns it too."""
    if df.schema[column].dataType.simpleString() == "string":
        sentinel: object = "\x00null"
    else:
        top = df.agg(F.max(column)).first()[0]
        sentinel = (top if top is not None else 0) + 1
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(sentinel))), sentinel


def split(df: DataFrame, key: str, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A part for a first fit, and the rest for updates; by hash, so a row is always on the same side."""
    first = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(1_000_000 * share)
    return df.where(first), df.where(~first)


def random_join(schema: Schema, tables: int, seed: int = 1) -> Query:
    """Tables connected by foreign keys."""
    rng, q = random.Random(seed), Query()
    q.add_alias(rng.choice(sorted(schema.tables)))
    while len(q.tables) < tables:
        ways = [fk for fk in schema.foreign_keys if (fk.table in q.tables) != (fk.key_table in q.tables)]
        if not ways:
            break
        fk = rng.choice(ways)
        q.add_alias(fk.key_table if fk.table in q.tables else fk.table).add_join(fk.table, fk.column, fk.key_table, fk.key_column)
    return q


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, degrees: Pearson's statistic of independence of two columns (null is a value)."""
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    left = both.groupBy(F.col(a).alias("_a")).agg(F.sum("n").alias("x"))
    right = both.groupBy(F.col(b).alias("_b")).agg(F.sum("n").alias("y"))
    sizes = left.agg(F.count("*").alias("r"), F.sum("x").alias("total")).crossJoin(F.broadcast(right.agg(F.count("*").alias("c"))))  # one row each
    # sum (n - e)^2 / e = sum n^2 / e - total, over pairs that occur
    terms = both.join(left, F.col(a).eqNullSafe(F.col("_a"))).join(right, F.col(b).eqNullSafe(F.col("_b"))).agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("x").cast("double") * F.col("y"))).alias("s"))
    return terms.crossJoin(F.broadcast(sizes)).select((F.col("total") * (F.col("s") - 1)).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("degrees"))


def partial_correlation(df: DataFrame, a: str, b: str, given: Sequence[str]) -> float:
    """Of a and b with the linear influence of the others taken out."""
    import numpy as np

    names = [a, b, *given]
    row = df.agg(*(F.corr(x, y) for x in names for y in names)).first()
    inverse = np.linalg.pinv(np.array(row, dtype=float).reshape(len(names), -1))
    return float(-inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]))
