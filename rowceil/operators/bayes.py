"""Tree Bayesian networks for result sizes: codes for values, pairwise mutual information, a Chow-Liu tree, conditional
tables, exact inference, and sizes of joins with fan-out columns.

Only counts come from the data, as grouped aggregates over small codes; trees and tables live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.factors import Factor
from ..plans.query import Predicate


@dataclass
class Coding:
    """How one column's values become codes: 0 is null; then common values, one each; then intervals of the rest.

    Of each interval the least and greatest value, the number of different values, and the mean and mean inverse are kept.
    """

    column: str
    common: dict[object, int] = field(default_factory=dict)
    edges: list = field(default_factory=list)
    low: dict[int, object] = field(default_factory=dict)
    high: dict[int, object] = field(default_factory=dict)
    distinct: dict[int, int] = field(default_factory=dict)
    mean: dict[int, float] = field(default_factory=dict)
    inverse: dict[int, float] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return 1 + len(self.common) + (len(self.edges) + 1 if self.low else 0)

    def column_code(self) -> Column:
        c = F.col(self.column)
        rest = F.lit(1 + len(self.common)) + (F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e < c)) if self.edges else F.lit(0))
        code = rest
        if self.common:
            known = F.create_map(*(x for v, i in self.common.items() for x in (F.lit(v), F.lit(i))))
            code = F.coalesce(F.element_at(known, c), rest)
        return F.when(c.isNull(), F.lit(0)).otherwise(code).cast("int")

    def weights(self, predicates: Sequence[Predicate]) -> np.ndarray:
        """For each code the share of its rows that satisfy all predicates; uniform within an interval."""
        w = np.ones(self.size)
        for p in predicates:
            w = w * np.array([self._share(code, p) for code in range(self.size)])
        return w

    def _share(self, code: int, p: Predicate) -> float:
        if p.op in ("IS NULL", "IS NOT NULL"):
            return float((code == 0) == (p.op == "IS NULL"))
        if code == 0:
            return 0.0
        by_code = {i: v for v, i in self.common.items()}
        if code in by_code:
            return float(holds(by_code[code], p))
        if code not in self.low:
            return 0.0
        lo, hi, n = self.low[code], self.high[code], self.distinct[code]
        if p.op in ("=", "IN"):
            values = {p.value} if p.op == "=" else set(p.value)
            return min(1.0, sum(v not in self.common and lo <= v <= hi for v in values) / n)
        if p.op in ("!=", "NOT IN"):
            return 1 - self._share(code, Predicate(p.alias, p.column, "=" if p.op == "!=" else "IN", p.value))
        if p.op in ("LIKE", "NOT LIKE"):
            return 0.1 if p.op == "LIKE" else 0.9
        a, b = (p.value if p.op == "BETWEEN" else (p.value, hi) if p.op in (">", ">=") else (lo, p.value))
        if isinstance(lo, str) or lo == hi:
            return float(holds(lo, p)) if lo == hi else float(not (a > hi or b < lo)) * (1.0 if a <= lo and b >= hi else 0.5)
        return max(0.0, min(1.0, (min(b, hi) - max(a, lo)) / (hi - lo)))


def holds(v, p: Predicate) -> bool:
    """Whether a value that isn't null satisfies a predicate."""
    from ..functions.text import like_matches

    x = p.value
    return {
        "=": lambda: v == x, "!=": lambda: v != x, "<": lambda: v < x, "<=": lambda: v <= x, ">": lambda: v > x, ">=": lambda: v >= x,
        "IN": lambda: v in x, "NOT IN": lambda: v not in x, "BETWEEN": lambda: x[0] <= v <= x[1],
        "LIKE": lambda: like_matches(str(v), x), "NOT LIKE": lambda: not like_matches(str(v), x), "IS NULL": lambda: False, "IS NOT NULL": lambda: True,
    }[p.op]()


def attribute_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """boolean for two different values, continuous for many (a twentieth of the rows, or over 3000 numbers), else categorical."""
    row = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in columns)).first()
    out = {}
    for c in columns:
        number = df.schema[c].dataType.simpleString() not in ("string", "boolean")
        out[c] = "boolean" if row[c] == 2 else "continuous" if number and (row[c] >= row["_n"] / 20 or row[c] > 3000) else "categorical"
    return out


def code_column(df: DataFrame, column: str, common: int = 40, bins: int = 20) -> Coding:
    """The most common values keep their identity; the rest of the values falls into intervals of about equal rows."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(common + 1).collect()
    out = Coding(column, {r[0]: i + 1 for i, r in enumerate(top[:common])})
    if len(top) <= common:
        return out
    number = df.schema[column].dataType.simpleString() != "string"
    rest = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*out.common))
    if number:
        out.edges = sorted(set(rest.agg(F.percentile_approx(column, [i / bins for i in range(1, bins)], 10_000)).first()[0]))
    code, x = out.column_code(), F.col(column).cast("double")
    for r in rest.groupBy(code.alias("c")).agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count_distinct(column).alias("n"), F.avg(x).alias("m"), F.avg(F.when(x != 0, 1 / x)).alias("i")).collect():
        out.low[r["c"]], out.high[r["c"]], out.distinct[r["c"]] = r["a"], r["b"], r["n"]
        out.mean[r["c"]], out.inverse[r["c"]] = r["m"], r["i"]
    return out


def contingency(df: DataFrame, child: str, parents: Sequence[str] = ()) -> DataFrame:
    """Rows for each combination of child and parent values."""
    return df.groupBy(child, *parents).agg(F.count("*").alias("n"))


#: The most states of a child that a smoothed table may have.
STATES = 10_000


def conditional_table(df: DataFrame, child: str, parent: str, prior: float = 0.0) -> DataFrame:
    """child, parent, p: the chance of child given parent. With `prior` every child state has a row under every parent
    value, and so much added to its count, also where the two do not occur together."""
    counts = contingency(df, child, [parent])
    if prior:
        states = [r[0] for r in counts.select(child).distinct().limit(STATES + 1).collect()]
        if len(states) > STATES:
            raise ValueError(f"{child} has more than {STATES} states")
        listed = counts.sparkSession.createDataFrame([(x,) for x in states], StructType([counts.schema[child]])).agg(F.collect_list(F.struct(child)).alias("_states"))  # one row
        grid = counts.select(F.col(parent).alias("_p")).distinct().join(F.broadcast(listed)).select("_p", F.explode("_states").alias("_c")).select("_p", F.col(f"_c.{child}").alias("_c"))
        found = grid.join(counts, F.col("_p").eqNullSafe(F.col(parent)) & F.col("_c").eqNullSafe(F.col(child)), "left")
        counts = found.select(F.col("_c").alias(child), F.col("_p").alias(parent), F.coalesce("n", F.lit(0)).alias("n"))
    sums = counts.groupBy(F.col(parent).alias("_p")).agg(F.sum(F.col("n") + prior).alias("_s"))
    return counts.join(sums, F.col(parent).eqNullSafe(F.col("_p"))).select(child, parent, ((F.col("n") + prior) / F.col("_s")).alias("p"))


def covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, cov, r for every two columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(x.alias(f"{kind}{i}") for i, (a, b) in enumerate(pairs) for kind, x in (("cov", F.covar_samp(a, b)), ("r", F.corr(a, b)))))
    made = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"cov{i}").alias("cov"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(made).alias("x")).select("x.*")


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi, in nats, of two columns (nulls are a value)."""
    both = contingency(df, a, [b])
    sides = [both.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b)]
    total = both.agg(F.sum("n").alias("n_all"))
    joined = both.join(sides[0], F.col(a).eqNullSafe(F.col(f"_{a}"))).join(sides[1], F.col(b).eqNullSafe(F.col(f"_{b}"))).crossJoin(F.broadcast(total))  # one row
    return joined.agg(F.sum(F.col("n") / F.col("n_all") * F.log(F.col("n") * F.col("n_all") / (F.col(f"n_{a}") * F.col(f"n_{b}")))).alias("mi"))


def pair_tables(coded: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], dict[tuple[int, int], int]]:
    """Counts of code pairs for every two columns, in one aggregation."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    if not pairs:
        return {}
    out: dict[tuple[str, str], dict[tuple[int, int], int]] = {}
    for r in coded.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.i", "p.j", "p.x", "p.y").count().collect():
        out.setdefault((columns[r["i"]], columns[r["j"]]), {})[r["x"], r["y"]] = r["count"]
    return out


def information_of(table: Mapping[tuple[int, int], int]) -> float:
    n = sum(table.values())
    x: dict[int, int] = {}
    y: dict[int, int] = {}
    for (a, b), c in table.items():
        x[a], y[b] = x.get(a, 0) + c, y.get(b, 0) + c
    return sum(c / n * math.log(c * n / (x[a] * y[b])) for (a, b), c in table.items())


def chow_liu(columns: Sequence[str], information: Mapping[tuple[str, str], float]) -> dict[str, str | None]:
    """Parent of each column in the tree of greatest total information, rooted at the first; ties by name."""
    parent: dict[str, str | None] = {columns[0]: None}
    while len(parent) < len(columns):
        best = max(((information.get((a, b), information.get((b, a), 0.0)), a, b) for a in parent for b in columns if b not in parent), key=lambda x: (x[0], x[1], x[2]))
        parent[best[2]] = best[1]
    return parent


@dataclass
class Network:
    """A tree network over coded columns."""

    codings: dict[str, Coding]
    parent: dict[str, str | None]
    counts: dict[str, np.ndarray]  # of a root by code; else by (code, parent's code)
    rows: float

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], common: int = 40, bins: int = 20) -> Network:
        codings = {c: code_column(df, c, common, bins) for c in columns}
        coded = df.select(*(codings[c].column_code().alias(c) for c in columns)).persist()
        pairs = pair_tables(coded, columns)
        singles = {c: {r[0]: r[1] for r in coded.groupBy(c).count().collect()} for c in columns}
        coded.unpersist()
        parent = chow_liu(columns, {k: information_of(t) for k, t in pairs.items()})
        counts = {}
        for c, p in parent.items():
            if p is None:
                a = np.zeros(codings[c].size)
                for x, n in singles[c].items():
                    a[x] = n
            else:
                a = np.zeros((codings[c].size, codings[p].size))
                for (x, y), n in pairs[(c, p) if (c, p) in pairs else (p, c)].items():
                    a[(x, y) if (c, p) in pairs else (y, x)] = n
            counts[c] = a
        return cls(codings, parent, counts, float(sum(singles[columns[0]].values())))

    def update(self, df: DataFrame) -> None:
        """Adds the counts of further rows; codes and tree stay."""
        coded = df.select(*(self.codings[c].column_code().alias(c) for c in self.parent)).persist()
        for c, p in self.parent.items():
            for r in coded.groupBy(*([c] if p is None else [c, p])).count().collect():
                self.counts[c][tuple(r[:-1])] += r[-1]
        self.rows += coded.count()
        coded.unpersist()

    def expectation(self, weights: Mapping[str, np.ndarray]) -> float:
        """E of the product of weights by code, one vector for each column that has any; from the leaves to the root."""
        children: dict[str | None, list[str]] = {}
        for c, p in self.parent.items():
            children.setdefault(p, []).append(c)

        def message(c: str) -> np.ndarray:
            v = weights.get(c, np.ones(self.codings[c].size)).astype(float)
            for k in children.get(c, []):
                v = v * message(k)
            if self.parent[c] is None:
                return v
            n = self.counts[c]
            s = n.sum(0)
            return (v @ n) / np.where(s > 0, s, 1)

        (root,) = children[None]
        n = self.counts[root]
        return float((message(root) * n).sum() / max(1.0, n.sum()))

    def probability(self, predicates: Sequence[Predicate]) -> float:
        by: dict[str, list[Predicate]] = {}
        for p in predicates:
            by.setdefault(p.column, []).append(p)
        return self.expectation({c: self.codings[c].weights(ps) for c, ps in by.items()})

    def cardinality(self, predicates: Sequence[Predicate]) -> float:
        return max(1.0, self.rows * self.probability(predicates))

    def independent(self, predicates: Sequence[Predicate]) -> float:
        """As if columns were independent."""
        out = self.rows
        for p in predicates:
            out *= self.probability([p])
        return max(1.0, out)

    def inverse_fan_out(self, column: str) -> np.ndarray:
        """1 / value by code (mean inverse within an interval)."""
        k = self.codings[column]
        w = np.zeros(k.size)
        for v, i in k.common.items():
            w[i] = 1 / v if v else 0.0
        for i, x in k.inverse.items():
            w[i] = x or 0.0
        return w

    def join_cardinality(self, predicates: Sequence[Predicate], unused_fan_outs: Sequence[str]) -> float:
        """Of a join of some tables from a network over the full join: other tables' fan-outs divide out."""
        by: dict[str, list[Predicate]] = {}
        for p in predicates:
            by.setdefault(p.column, []).append(p)
        w = {c: self.codings[c].weights(ps) for c, ps in by.items()}
        for c in unused_fan_outs:
            w[c] = w.get(c, 1.0) * self.inverse_fan_out(c)
        return max(1.0, self.rows * self.expectation(w))

    def factors(self) -> list[Factor]:
        """The network's tables, for general inference."""
        out = []
        for c, p in self.parent.items():
            n = self.counts[c]
            out.append(Factor((c,), n / max(1.0, n.sum())) if p is None else Factor((c, p), n / np.where(n.sum(0) > 0, n.sum(0), 1)))
        return out

    def sample(self, rows: int, seed: int = 1) -> dict[str, np.ndarray]:
        """Codes of rows drawn from the network, parents first."""
        rng, out = np.random.default_rng(seed), {}
        todo = list(self.parent)
        while todo:
            c = next(x for x in todo if self.parent[x] is None or self.parent[x] in out)
            todo.remove(c)
            n = self.counts[c]
            if self.parent[c] is None:
                out[c] = rng.choice(len(n), rows, p=n / n.sum())
            else:
                given = out[self.parent[c]]
                cdf = np.cumsum(n / np.where(n.sum(0) > 0, n.sum(0), 1), axis=0)
                out[c] = np.minimum((rng.random(rows)[None, :] > cdf[:, given]).sum(0), n.shape[0] - 1)
        return out

    def sampled_probability(self, predicates: Sequence[Predicate], rows: int = 10_000, seed: int = 1) -> float:
        drawn, w = self.sample(rows, seed), np.ones(rows)
        for p in predicates:
            w = w * self.codings[p.column].weights([p])[drawn[p.column]]
        return float(w.mean())

    def progressive_probability(self, predicates: Sequence[Predicate], rows: int = 1000, seed: int = 1) -> float:
        """Parents first, each code drawn among those that the predicates allow; the allowed shares multiply."""
        by: dict[str, list[Predicate]] = {}
        for p in predicates:
            by.setdefault(p.column, []).append(p)
        rng, drawn, w = np.random.default_rng(seed), {}, np.ones(rows)
        todo = list(self.parent)
        while todo:
            c = next(x for x in todo if self.parent[x] is None or self.parent[x] in drawn)
            todo.remove(c)
            n = self.counts[c]
            table = np.repeat((n / max(1.0, n.sum()))[:, None], rows, axis=1) if self.parent[c] is None else (n / np.where(n.sum(0) > 0, n.sum(0), 1))[:, drawn[self.parent[c]]]
            table = table * self.codings[c].weights(by.get(c, ()))[:, None]
            share = table.sum(0)
            w = w * share
            cdf = np.cumsum(table / np.where(share > 0, share, 1), axis=0)
            drawn[c] = np.minimum((rng.random(rows)[None, :] > cdf).sum(0), n.shape[0] - 1)
        return float(w.mean())


def save_network(spark, net: Network, path: str) -> None:
    """Conditional tables as Parquet, everything else as one JSON row."""
    import json

    rows = [(c, p, int(i[0]), int(i[1]) if len(i) > 1 else None, float(net.counts[c][i])) for c, p in net.parent.items() for i in zip(*np.nonzero(net.counts[c]), strict=True)]
    spark.createDataFrame(rows, "child string, parent string, child_code int, parent_code int, n double").write.mode("overwrite").parquet(f"{path}/tables")
    head = {"parent": net.parent, "rows": net.rows, "codings": {c: {"common": [[v, i] for v, i in k.common.items()], "edges": k.edges, **{f: [[i, v] for i, v in getattr(k, f).items()] for f in ("low", "high", "distinct", "mean", "inverse")}} for c, k in net.codings.items()}}
    spark.createDataFrame([(json.dumps(head, default=str),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load_network(spark, path: str) -> Network:
    import json

    h = json.loads(spark.read.parquet(f"{path}/head").first()[0])
    codings = {c: Coding(c, {v: i for v, i in k["common"]}, k["edges"], **{f: dict(map(tuple, k[f])) for f in ("low", "high", "distinct", "mean", "inverse")}) for c, k in h["codings"].items()}
    counts = {c: np.zeros(codings[c].size if p is None else (codings[c].size, codings[p].size)) for c, p in h["parent"].items()}
    for r in spark.read.parquet(f"{path}/tables").collect():
        counts[r["child"]][(r["child_code"],) if r["parent_code"] is None else (r["child_code"], r["parent_code"])] = r["n"]
    return Network(codings, h["parent"], counts, h["rows"])
