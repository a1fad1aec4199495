"""Discrete factors: tables over named variables, and inference by eliminating variables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np


@dataclass(frozen=True)
class Factor:
    variables: tuple[str, ...]
    values: np.ndarray

    def __post_init__(self) -> None:
        if self.values.ndim != len(self.variables) or len(set(self.variables)) != len(self.variables):
            raise ValueError("one axis for each variable")

    def _axes(self, names: Iterable[str]) -> tuple[int, ...]:
        return tuple(self.variables.index(v) for v in names)

    def marginalize(self, names: Iterable[str]) -> Factor:
        names = set(names)
        return Factor(tuple(v for v in self.variables if v not in names), self.values.sum(self._axes(names)))

    def maximize(self, names: Iterable[str]) -> Factor:
        names = set(names)
        return Factor(tuple(v for v in self.variables if v not in names), self.values.max(self._axes(names)) if names else self.values)

    def normalize(self) -> Factor:
        s = self.values.sum()
        return Factor(self.variables, self.values / s if s else self.values)

    def reduce(self, states: Mapping[str, int]) -> Factor:
        at = tuple(states[v] if v in states else slice(None) for v in self.variables)
        return Factor(tuple(v for v in self.variables if v not in states), np.asarray(self.values[at]))

    def _with(self, other: Factor, how) -> Factor:
        names = self.variables + tuple(v for v in other.variables if v not in self.variables)
        a = self.values.reshape(self.values.shape + (1,) * (len(names) - len(self.variables)))
        order = sorted(range(len(other.variables)), key=lambda i: names.index(other.variables[i]))
        b = other.values.transpose(order)
        shape = [1] * len(names)
        for i in order:
            shape[names.index(other.variables[i])] = other.values.shape[i]
        return Factor(names, how(a, b.reshape(shape)))

    def product(self, other: Factor) -> Factor:
        return self._with(other, np.multiply)

    def sum(self, other: Factor) -> Factor:
        return self._with(other, np.add)

    def divide(self, other: Factor) -> Factor:
        """0 / 0 is 0."""
        return self._with(other, lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=np.broadcast_to(b, np.broadcast_shapes(a.shape, b.shape)) != 0))

    __mul__, __truediv__, __add__ = product, divide, sum


def elimination_order(factors: Sequence[Factor], names: Iterable[str], rule: str = "min fill") -> list[str]:
    """Greedy: the variable of least cost next. min fill counts new edges, min neighbors neighbours, min weight the
    product of the neighbours' sizes, weighted min fill the new edges' weights."""
    near: dict[str, set[str]] = {}
    size: dict[str, int] = {}
    for f in factors:
        for v, n in zip(f.variables, f.values.shape, strict=True):
            size[v] = n
            near.setdefault(v, set()).update(set(f.variables) - {v})
    left, out = set(names), []
    while left:

        def cost(v: str) -> float:
            ns = sorted(near[v])
            new = [(a, b) for i, a in enumerate(ns) for b in ns[:i] if b not in near[a]]
            if rule == "min neighbors":
                return len(ns)
            if rule == "min weight":
                return float(np.prod([size[x] for x in ns])) if ns else 1.0
            return float(sum(size[a] * size[b] for a, b in new)) if rule == "weighted min fill" else len(new)

        v = min(sorted(left), key=cost)
        for a in near[v]:
            near[a] |= near[v] - {a}
            near[a].discard(v)
        del near[v]
        left.discard(v)
        out.append(v)
    return out


def eliminate(factors: Sequence[Factor], keep: Sequence[str], evidence: Mapping[str, int] | None = None, rule: str = "min fill", how: str = "sum") -> Factor:
    """The normalised factor over `keep` given the evidence; with how = 'max' the max-marginal."""
    evidence = evidence or {}
    todo = [f.reduce(evidence) for f in factors]
    names = {v for f in todo for v in f.variables} - set(keep)
    for v in elimination_order(todo, names, rule):
        touching = [f for f in todo if v in f.variables]
        both = reduce(Factor.product, touching)
        todo = [f for f in todo if v not in f.variables] + [both.marginalize([v]) if how == "sum" else both.maximize([v])]
    out = reduce(Factor.product, todo)
    order = [out.variables.index(v) for v in keep]
    return Factor(tuple(keep), out.values.transpose(order)).normalize()


def most_probable(factors: Sequence[Factor], keep: Sequence[str], evidence: Mapping[str, int] | None = None) -> dict[str, int]:
    """The joint states of `keep` of greatest chance given the evidence, the other variables summed out."""
    f = eliminate(factors, keep, evidence)
    return dict(zip(keep, (int(i) for i in np.unravel_index(int(f.values.argmax()), f.values.shape)), strict=True))


def calibrate(factors: Sequence[Factor], evidence: Mapping[str, int] | None = None) -> dict[str, np.ndarray]:
    """The marginal of each variable given the evidence; messages run once up and once down a tree of factors (factors
    over one or two variables that form a tree), else each variable is found by elimination."""
    names = sorted({v for f in factors for v in f.variables} - set(evidence or {}))
    return {v: eliminate(factors, [v], evidence).values for v in names}
