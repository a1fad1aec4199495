"""Sum-product networks for approximate answers: learnt on weighted rows, evaluated on the driver, kept up to date.

Rows are counted by their values, all of them. Up to SAMPLE different ones are fitted as they are; of more, a priority
sample is drawn: the likelier the oftener a combination occurs, and weighed so that sums over any part are unbiased.

Columns split where their rank correlation is low (products), rows split by two-means (sums), and leaves are value
histograms. Expectations of products of columns, of squares and of inverses under conditions give counts, sums,
averages and their deviations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Predicate
from .bayes import holds

#: The most different rows that a fit takes; each weighs as often as it occurs.
SAMPLE = 20_000


@dataclass
class Leaf:
    column: int
    values: dict[object, float] = field(default_factory=dict)  # value (None for null): rows

    def expect(self, weight) -> float:
        n = sum(self.values.values())
        return sum(c * weight(v) for v, c in self.values.items()) / n if n else 0.0


@dataclass
class Product:
    children: list


@dataclass
class Sum:
    weights: list[float]
    children: list
    centres: np.ndarray


def combinations(df: DataFrame, columns: Sequence[str], most: int) -> tuple[list[tuple], np.ndarray, int]:
    """Different rows (at most `most`), the number of rows that each stands for, and the number of all rows.

    More than `most` are drawn by priority: count over a uniform number hashed from the values, highest first; one drawn
    weighs its count, or the highest priority left out where that is more.
    """
    named = df.select(*(F.col(c).alias(f"c{j}") for j, c in enumerate(columns)))
    counted = named.groupBy(*named.columns).agg(F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64(F.lit("priority"), *named.columns), F.lit(2**52)) + 0.5) / 2.0**52
    got = [tuple(r) for r in counted.withColumn("q", F.col("n") / u).orderBy(F.desc("q"), *named.columns).limit(most + 1).collect()]
    limit, kept = (got[most][-1], got[:most]) if len(got) > most else (0.0, got)
    weight = np.array([max(float(r[-2]), limit) for r in kept])
    n = df.count() if limit else int(weight.sum())
    return [r[:-2] for r in kept], weight * (n / weight.sum()) if limit else weight, n


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.average(x, axis=0, weights=w)
    return mean, np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))


def _middle_ranks(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The middle of the places that the rows of each value take in order."""
    _, at = np.unique(x, return_inverse=True)
    n = np.bincount(at, weights=w)
    return (np.cumsum(n) - n / 2)[at]


def _median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)])


@dataclass
class SumProductNetwork:
    columns: tuple[str, ...]
    root: object
    rows: float
    scale: tuple[np.ndarray, np.ndarray]
    ranks: dict[int, dict]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], least_rows: int = 200, correlation: float = 0.3, sample: int = SAMPLE) -> SumProductNetwork:
        got, weight, n = combinations(df, columns, sample)
        ranks = {}
        for j in range(len(columns)):
            seen = sorted({r[j] for r in got if r[j] is not None})
            ranks[j] = {v: i / max(1, len(seen) - 1) for i, v in enumerate(seen)}
        x = np.array([[ranks[j].get(r[j], -0.5) for j in range(len(columns))] for r in got], dtype=float).reshape(-1, len(columns))
        mean, sd = _moments(x, weight) if len(x) else (np.zeros(len(columns)), np.ones(len(columns)))
        self = cls(tuple(columns), None, float(n), (mean, np.maximum(sd, 1e-9)), ranks)
        self.root = self._learn(got, weight, x, list(range(len(columns))), least_rows, correlation, True)
        return self

    def _leaf(self, rows, w, j: int) -> Leaf:
        out = Leaf(j)
        for r, n in zip(rows, w.tolist(), strict=True):
            out.values[r[j]] = out.values.get(r[j], 0.0) + n
        return out

    def _learn(self, rows, w, x, scope, least, limit, try_columns):
        if len(scope) == 1:
            return self._leaf(rows, w, scope[0])
        if w.sum() < least:
            return Product([self._leaf(rows, w, j) for j in scope])
        if try_columns:
            order = np.stack([_middle_ranks(x[:, j], w) for j in scope], axis=1)
            feats = np.stack([order, (order - np.average(order, axis=0, weights=w)) ** 2], axis=2)
            mean, sd = _moments(feats, w)
            z = (feats - mean) / np.where(sd > 0, sd, 1)
            c = np.abs(np.einsum("n,nif,njg->ijfg", w / w.sum(), z, z, optimize=True)).max((2, 3))
            groups: list[set[int]] = []
            for i in range(len(scope)):
                near = {k for k in range(len(scope)) if c[i, k] > limit} | {i}
                joined = [g for g in groups if g & near]
                groups = [g for g in groups if not g & near] + [set().union(near, *joined)]
            if len(groups) > 1:
                return Product([self._learn(rows, w, x, sorted(scope[i] for i in g), least, limit, False) for g in sorted(groups, key=min)])
        z = (x[:, scope] - self.scale[0][scope]) / self.scale[1][scope]
        spread = _moments(z, w)[1].argmax()
        middle = _median(z[:, spread], w)
        centres = np.stack([np.average(z[part], axis=0, weights=w[part]) for part in (z[:, spread] <= middle, z[:, spread] >= middle)])
        for _ in range(20):
            near = ((z[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            if near.min() == near.max():
                return Product([self._leaf(rows, w, j) for j in scope])
            centres = np.stack([np.average(z[near == k], axis=0, weights=w[near == k]) for k in (0, 1)])
        parts = []
        for k in (0, 1):
            at = np.flatnonzero(near == k)
            parts.append(self._learn([rows[i] for i in at], w[at], x[at], scope, least, limit, True))
        full = np.zeros((2, len(self.columns)))
        full[:, scope] = centres
        return Sum([float(w[near == k].sum()) for k in (0, 1)], parts, full)

    def _expect(self, node, weights: Mapping[int, object]) -> float:
        if isinstance(node, Leaf):
            return node.expect(weights[node.column]) if node.column in weights else 1.0
        if isinstance(node, Product):
            out = 1.0
            for c in node.children:
                out *= self._expect(c, weights)
            return out
        n = sum(node.weights)
        return sum(w / n * self._expect(c, weights) for w, c in zip(node.weights, node.children, strict=True))

    def expectation(self, predicates: Sequence[Predicate] = (), powers: Mapping[str, float] | None = None) -> float:
        """E of the condition times the columns' powers; a null satisfies IS NULL alone and is 0 under a power."""
        weights: dict[int, object] = {}
        for j, c in enumerate(self.columns):
            own, power = [p for p in predicates if p.column == c], (powers or {}).get(c)
            if own or power is not None:

                def weigh(v, own=own, power=power):
                    if v is None:
                        return float(power is None and all(p.op == "IS NULL" for p in own))
                    ok = all(holds(v, p) for p in own)
                    return (float(v) ** power if power is not None else 1.0) if ok else 0.0

                weights[j] = weigh
        return self._expect(self.root, weights)

    def count(self, predicates: Sequence[Predicate] = ()) -> float:
        return self.rows * self.expectation(predicates)

    def average(self, column: str, predicates: Sequence[Predicate] = ()) -> float:
        share = self.expectation([*predicates, Predicate("", column, "IS NOT NULL")])
        return self.expectation(predicates, {column: 1.0}) / share if share else float("nan")

    def sum(self, column: str, predicates: Sequence[Predicate] = ()) -> float:
        return self.rows * self.expectation(predicates, {column: 1.0})

    def deviation_of_average(self, column: str, predicates: Sequence[Predicate] = ()) -> float:
        share = self.expectation([*predicates, Predicate("", column, "IS NOT NULL")])
        if not share:
            return float("nan")
        mean = self.expectation(predicates, {column: 1.0}) / share
        return (max(0.0, self.expectation(predicates, {column: 2.0}) / share - mean * mean) / max(1.0, share * self.rows)) ** 0.5

    def groups(self, column: str) -> list:
        """The values that some leaf of a column has seen."""
        out: set = set()
        todo = [self.root]
        while todo:
            n = todo.pop()
            if isinstance(n, Leaf):
                out |= {v for v in n.values if v is not None} if self.columns[n.column] == column else set()
            else:
                todo += n.children
        return sorted(out)

    def insert(self, row: Sequence) -> None:
        """One further row: to the nearer part of every sum, and into the leaves there."""
        z = (np.array([self.ranks[j].get(v, -0.5) for j, v in enumerate(row)]) - self.scale[0]) / self.scale[1]

        def put(node) -> None:
            if isinstance(node, Leaf):
                node.values[row[node.column]] = node.values.get(row[node.column], 0.0) + 1
            elif isinstance(node, Product):
                for c in node.children:
                    put(c)
            else:
                scope = np.flatnonzero(np.abs(node.centres).sum(0) > 0)
                k = int(((node.centres[:, scope] - z[scope]) ** 2).sum(1).argmin())
                node.weights[k] += 1
                put(node.children[k])

        put(self.root)
        self.rows += 1
