"""Aggregate queries: exact, from a sample with confidence intervals, and under what-if weights."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_sample
from ..plans.parser import Aggregate, AggregateQuery
from .exact import joined, predicate_column

Z90 = 1.6448536269514722  # two-sided 90 per cent


def _needed(a: AggregateQuery) -> list[tuple[str, str]]:
    columns = [*a.group_by, *(c for t in a.terms for c in t.columns), *((p.alias, p.column) for ps, _ in a.what_if for p in ps)]
    return list(dict.fromkeys(columns))


def _rows(tables: Mapping[str, DataFrame], a: AggregateQuery) -> DataFrame:
    """Joined rows with the columns that the aggregates need, and _w, the weight that what-if clauses give a row."""
    need = _needed(a)
    df = joined(tables, a.query, need or [next((x, tables[t].columns[0]) for x, t in a.query.tables.items())])
    w = F.lit(1.0)
    for predicates, change in a.what_if:
        hit = reduce(Column.__and__, (predicate_column(df, p, f"{p.alias}__") for p in predicates))
        w = w * F.when(hit, F.lit(1.0 + change)).otherwise(F.lit(1.0))
    return df.withColumn("_w", w)


def _product(t: Aggregate) -> Column:
    return reduce(Column.__mul__, (F.col(f"{a}__{c}").cast("double") for a, c in t.columns))


def _value(t: Aggregate) -> Column:
    if t.kind == "COUNT":
        return F.sum("_w")
    x = _product(t)
    if t.kind == "SUM":
        return F.sum(x * F.col("_w"))
    return F.sum(x * F.col("_w")) / F.sum(F.when(x.isNotNull(), F.col("_w")))


def _groups(a: AggregateQuery) -> list[Column]:
    return [F.col(f"{x}__{c}").alias(c) for x, c in a.group_by]


def evaluate(tables: Mapping[str, DataFrame], a: AggregateQuery) -> DataFrame:
    """Group columns and `value`, exact; with WHAT IF clauses every row counts by its weight."""
    value = reduce(Column.__add__, (_value(t) * F.lit(float(t.sign)) for t in a.terms))
    return _rows(tables, a).groupBy(*_groups(a)).agg(value.alias("value"))


def approximate(tables: Mapping[str, DataFrame], a: AggregateQuery, alias: str, column: str, share: float) -> DataFrame:
    """Group columns, value, low, high (a 90 per cent interval) from a hash sample of one alias by a column.

    Rows with one value of the column come or stay away together, so they are first added up: a sum over all rows is
    estimated from the sums of the values sampled (Horvitz and Thompson), an average as a ratio of two of these.
    """
    t = a.query.tables[alias]
    sampled = dict(tables)
    q = a.query.copy()
    q.tables[alias] = "_sampled"
    sampled["_sampled"] = tables[t].where(hash_sample(F.col(column), share))
    inner = AggregateQuery(q, a.terms, [*a.group_by, (alias, column)], a.what_if)
    groups = [c for _, c in a.group_by]
    x = reduce(Column.__add__, ((F.col("_w") if t.kind == "COUNT" else _product(t) * F.col("_w")) * F.lit(float(t.sign)) for t in a.terms))
    n = F.when(_product(a.terms[0]).isNotNull(), F.col("_w")).otherwise(0.0) if a.terms[0].kind == "AVG" else F.lit(1.0)
    each = _rows(sampled, inner).groupBy(*_groups(a), F.col(f"{alias}__{column}").alias("_unit")).agg(F.sum(x).alias("x"), F.sum(n).alias("n"))
    if a.terms[0].kind == "AVG":
        sums = each.groupBy(*groups).agg((F.sum("x") / F.sum("n")).alias("value"), F.sum("n").alias("sn"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("n")).alias("xn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        v, r = F.col("value"), F.lit(1 - share)
        spread = F.sqrt(F.greatest(r * (F.col("xx") - 2 * v * F.col("xn") + v * v * F.col("nn")), F.lit(0.0))) / F.col("sn")
    else:
        sums = each.groupBy(*groups).agg((F.sum("x") / share).alias("value"), F.sum(F.col("x") * F.col("x")).alias("xx"))
        spread = F.sqrt(F.lit(1 - share) * F.col("xx")) / share
    return sums.select(*groups, "value", (F.col("value") - Z90 * spread).alias("low"), (F.col("value") + Z90 * spread).alias("high"))


def interval_of_product(means: list[float], deviations: list[float]) -> tuple[float, float]:
    """Mean and standard deviation of a product of independent factors."""
    second = first = 1.0
    for m, s in zip(means, deviations, strict=True):
        second *= s * s + m * m
        first *= m * m
    return first**0.5 * (-1 if sum(m < 0 for m in means) % 2 else 1), max(second - first, 0.0) ** 0.5
