"""Bounds from SQL: a table function over statistics."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.statistics import Statistics


def register_bound(spark: SparkSession, stats: Statistics, name: str = "dsb_bound") -> None:
    """SELECT * FROM dsb_bound('SELECT ...') gives one row, bound: no less than the rows of the query in its argument.

    The statistics go to the workers with the function; they are as large as Statistics.memory says.
    """

    class Bound:
        def eval(self, sql: str):
            from rowceil.plans.bound import bound
            from rowceil.plans.parser import parse_one

            yield (float(bound(stats, parse_one(sql))),)

    spark.udtf.register(name, udtf(Bound, returnType="bound double"))
