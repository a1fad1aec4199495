"""Sizes of joins over several tables from one network for each foreign key.

A network is fitted to its key table's rows joined with the rows that refer to them; keys without any stay, with nulls.
Columns: those of both tables, a flag that a referring row is there, and how many there are. A query starts with the
network that sees most predicates; each further one multiplies by its own size with the predicates of both its tables
and divides by that of the table which is already in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ForeignKey, Schema
from ..plans.query import Predicate, Query
from .bayes import Network
from .exact import fan_out


@dataclass
class Ensemble:
    schema: Schema
    networks: dict[ForeignKey, Network]

    @classmethod
    def fit(cls, tables: Mapping[str, DataFrame], schema: Schema, columns: Mapping[str, Sequence[str]], common: int = 40, bins: int = 20) -> Ensemble:
        made = {}
        for fk in schema.foreign_keys:
            if fk.table not in tables or fk.key_table not in tables:
                continue
            left = fan_out(tables[fk.key_table].select(fk.key_column, *columns.get(fk.key_table, ())), fk.key_column, tables[fk.table], fk.column, "_mul").drop("_mul")
            right = tables[fk.table].select(F.col(fk.column).alias("_fk"), F.lit(1).alias("_there"), *columns.get(fk.table, ()))
            rows = left.join(right, F.col(fk.key_column) == F.col("_fk"), "left").withColumn("_there", F.coalesce("_there", F.lit(0)))
            made[fk] = Network.fit(rows, ["_there", "_mul_nn", *columns.get(fk.key_table, ()), *columns.get(fk.table, ())], common, bins)
        return cls(schema, made)

    def _size(self, fk: ForeignKey, key: Sequence[Predicate], own: Sequence[Predicate] | None) -> float:
        """Rows of the join, or with own = None of the key table, that satisfy predicates."""
        net = self.networks[fk]
        by: dict[str, list[Predicate]] = {}
        for p in (*key, *(own or ())):
            by.setdefault(p.column, []).append(p)
        w = {c: net.codings[c].weights(ps) for c, ps in by.items() if c in net.codings}
        if own is None:
            w["_mul_nn"] = net.inverse_fan_out("_mul_nn")
        else:
            there = np.zeros(net.codings["_there"].size)
            if 1 in net.codings["_there"].common:
                there[net.codings["_there"].common[1]] = 1.0
            w["_there"] = there
        return net.rows * net.expectation(w)

    def cardinality(self, q: Query) -> float:
        """Of a query whose joins are foreign keys that form a tree."""
        edges = []
        for j in q.joins:
            for fk in self.networks:
                for (a, ca), (b, cb) in ((j.left, j.right), (j.right, j.left)):
                    if (q.tables[a], ca, q.tables[b], cb) == (fk.table, fk.column, fk.key_table, fk.key_column):
                        edges.append((fk, a, b))
        if len(edges) != len(q.joins) or len(edges) != len(q.tables) - 1 or not edges:
            raise ValueError("joins must be known foreign keys that form a tree")
        of = lambda alias: [p for p in q.predicates if p.alias == alias]
        edges.sort(key=lambda e: (-len(of(e[1])) - len(of(e[2])), e[1], e[2]))
        fk, a, b = edges.pop(0)
        out, inside = self._size(fk, of(b), of(a)), {a, b}
        while edges:
            i = next(i for i, (_, x, y) in enumerate(edges) if x in inside or y in inside)
            fk, a, b = edges.pop(i)
            both = self._size(fk, of(b), of(a))
            overlap = self._size(fk, [], of(a)) if a in inside else self._size(fk, of(b), None)
            out *= both / overlap if overlap else 0.0
            inside |= {a, b}
        return max(1.0, out)
