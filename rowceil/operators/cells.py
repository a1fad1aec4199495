"""Degrees of keys within a few cells of filter columns, counted by DataFrame operations alone.

Where a filter column has few values, or only ranges of it are looked up, its values fall into few cells: single values, or
the base buckets between interval edges. A row for each key holds the key's rows in every cell; keys that are alike in all
of them are counted together, and only then a degree is taken in every bucket, which is a sum over cells. All rows of the
table, with or without a value, are in the same sums, so that these give a table's own degrees too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different values of a filter column that are cells of their own.
FEW = 24
FULL, NULL, NOT_NULL = "full", "null", "not null"


@dataclass
class Cells:
    """Of a filter column."""

    kind: str  # as Spark names it
    number: Column  # of a row's cell, null for null; of the filter column's own table
    edges: list
    intervals: list[tuple[str, int, int]]  # name, first and last base bucket
    bases: list[int]  # base bucket of each cell
    values: list[str] | None  # the value of each cell, as text; None: cells are base buckets
    rows: list[int]  # of each cell in the column's own table
    null: int

    def buckets(self) -> list[tuple[str, list[int]]]:
        """Name and cells; those without cells are left out."""
        every = list(range(len(self.bases)))
        out = [(NOT_NULL, every), *((f"interval {name}", [j for j in every if first <= self.bases[j] <= last]) for name, first, last in self.intervals)]
        return [(name, own) for name, own in (*out, *((f"value {j}", [j]) for j in every if self.values is not None)) if own]


def numbered(cells: list[Cells]) -> list[Column]:
    return [c.number.cast("int").alias(f"c{i}") for i, c in enumerate(cells)]


def _each(cells: list[Cells], weight: Column, there: Column) -> list[tuple[str, Column]]:
    """s{i}_{j}: weight in the j-th cell of the i-th filter column; z{i}: with null."""
    of = lambda where: F.when(where, weight).otherwise(F.lit(0).cast("long"))
    return [x for i, c in enumerate(cells) for x in (*((f"s{i}_{j}", of(F.col(f"c{i}") == j)) for j in range(len(c.bases))), (f"z{i}", of(there & F.col(f"c{i}").isNull())))]


def _alike(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*(c for c in keys.columns if c != "k")).agg(F.count("*").alias("m"))


def own_keys(rows: DataFrame, column: str, cells: list[Cells]) -> DataFrame:
    """m: keys of a column that are alike in a, their rows, and in those of each cell, given `numbered` filter columns of the same rows.

    Narrow rows are dealt, and a key's are added up as they come.
    """
    dealt = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("k"), *(f"c{i}" for i in range(len(cells)))).repartition("k")
    return _alike(dealt.groupBy("k").agg(F.count("*").alias("a"), *(F.sum(x).alias(name) for name, x in _each(cells, F.lit(1).cast("long"), F.lit(True)))))


def reached_keys(rows: DataFrame, column: str, key_rows: DataFrame, key_column: str, cells: list[Cells], unique: bool) -> DataFrame:
    """The same of a foreign key column, also of keys that refer to nothing, given filter columns of the rows it refers to.

    unique: no two of key_rows have one key, so that a key's rows are all in one cell and need no sums.
    """
    by_key = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    right = key_rows.where(F.col(key_column).isNotNull()).select(F.col(key_column).alias("_k"), *numbered(cells))
    joined, each = by_key.join(right, F.col("k") == F.col("_k"), "left"), _each(cells, F.col("n"), F.col("there"))
    joined = joined.select("k", "n", F.col("_k").isNotNull().alias("there"), *(f"c{i}" for i in range(len(cells))))
    if unique:
        return _alike(joined).select(F.col("n").alias("a"), *(x.alias(name) for name, x in each), "m")
    return _alike(joined.groupBy("k").agg(F.max("n").alias("a"), *(F.sum(x).alias(name) for name, x in each)))


def runs(alike: DataFrame, cells: list[Cells]) -> tuple[DataFrame, list[str]]:
    """bucket (its place among the names that follow), d, n: keys of each degree in each bucket. A name begins with the filter column's number."""
    named = [(FULL, F.col("a"))]
    for i, c in enumerate(cells):
        named.append((f"{i} {NULL}", F.col(f"z{i}")))
        named += [(f"{i} {name}", sum((F.col(f"s{i}_{j}") for j in own[1:]), F.col(f"s{i}_{own[0]}"))) for name, own in c.buckets()]
    each = alike.select("m", F.posexplode(F.array(*(d for _, d in named))).alias("bucket", "d")).where("d > 0")
    return each.groupBy("bucket", "d").agg(F.sum("m").alias("n")), [name for name, _ in named]
