"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(pairs: DataFrame) -> DataFrame:
    """For each first node: the smallest of itself and its partners, beside each of its partners."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return pairs.join(least, "a")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns a and b, in any direction, with repeats and loops allowed; rows with a null are ignored.

    Returns node, component for every node of an edge between two different nodes: component is the smallest
    node that can be reached. No edges give no rows. Each step is a partial aggregation and a join that adaptive
    execution can split, so a hub with very many partners is no single task's work; each round is checkpointed.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = checkpointed(_stars(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = _stars(large)
        small = down.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = checkpointed(small)
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find inside one task: the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        """False if they were together already."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
