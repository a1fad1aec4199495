"""Exact evaluation in Spark: predicates as columns, queries as joins, degree sequences and what is counted from them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import ForeignKey
from ..plans.query import AnyOf, Predicate, Query

Tables = Mapping[str, DataFrame]
#: Rows of aliases and, about, distinct values of their join columns.
Sizes = tuple[dict[str, float], dict[tuple[str, str], float]]


def _literal(df: DataFrame, name: str, value):
    kind = df.schema[name].dataType.simpleString()
    return F.lit(value).cast(kind) if isinstance(value, str) and kind != "string" else F.lit(value)


def predicate_column(df: DataFrame, p: Predicate | AnyOf, prefix: str = "") -> Column:
    """The condition on df's columns; strings compared with other types are cast to the column's type."""
    if isinstance(p, AnyOf):
        return reduce(Column.__or__, (predicate_column(df, x, prefix) for x in p.parts))
    name = prefix + p.column
    c, lit = F.col(name), lambda v: _literal(df, name, v)
    if p.op == "IN":
        return c.isin(*map(lit, p.value))
    if p.op == "NOT IN":
        return ~c.isin(*map(lit, p.value))
    if p.op == "BETWEEN":
        return c.between(lit(p.value[0]), lit(p.value[1]))
    if p.op == "LIKE":
        return c.like(p.value)
    if p.op == "NOT LIKE":
        return ~c.like(p.value)
    if p.op == "IS NULL":
        return c.isNull()
    if p.op == "IS NOT NULL":
        return c.isNotNull()
    v = lit(p.value)
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[p.op]


def alias_rows(tables: Tables, q: Query, alias: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of one alias that its predicates leave, with columns named alias__column; of `keep` alone if given."""
    df = tables[q.tables[alias]]
    for p in (*q.predicates, *q.any_of):
        if p.alias == alias:
            df = df.where(predicate_column(df, p))
    for p in q.in_queries:
        if p.alias == alias:
            inner = joined(tables, p.query, [p.out]).toDF("_in")
            df = df.join(inner, F.col(p.column) == F.col("_in"), "left_semi")
    names = df.columns if keep is None else list(dict.fromkeys(keep))
    return df.select(*(F.col(c).alias(f"{alias}__{c}") for c in names))


def joined(tables: Tables, q: Query, out: Sequence[tuple[str, str]] = (), order: Sequence[str] | None = None, broadcast: Sequence[str] = ()) -> DataFrame:
    """The join of all aliases, in the order given (else breadth first), with the columns `out` (alias, column).

    Only join columns and those of `out` leave the scans. Parts that no join connects are multiplied. Aliases in
    `broadcast` get a hint; the caller has checked their size.
    """
    need: dict[str, list[str]] = {a: [] for a in q.tables}
    for x in (*(s for j in q.joins for s in (j.left, j.right)), *out):
        need[x[0]].append(x[1])
    if order is None:
        order = []
        for part in q.parts():
            order += [part[0], *(b for _, _, b, _ in q.walk(part[0]))]
    df, seen = None, []
    for a in order:
        rows = alias_rows(tables, q, a, need[a])
        own = [j for j in q.joins if j.aliases == {a}]
        for j in own:
            rows = rows.where(F.col(f"{a}__{j.left[1]}") == F.col(f"{a}__{j.right[1]}"))
        if a in broadcast:
            rows = F.broadcast(rows)
        if df is None:
            df = rows
        else:
            on = [F.col("__".join(j.left)) == F.col("__".join(j.right)) for j in q.joins if a in j.aliases and len(j.aliases) == 2 and j.aliases - {a} <= set(seen)]
            df = df.join(rows, reduce(Column.__and__, on)) if on else df.crossJoin(rows)
        seen.append(a)
    return df.select(*(F.col(f"{a}__{c}") for a, c in out)) if out else df


def counted(tables: Tables, q: Query, order: Sequence[str] | None = None, broadcast: Sequence[str] = (), sizes: Sizes | None = None) -> DataFrame:
    """n: rows of the join, counted without making them; parts that no join connects are counted each and multiplied.

    Aliases are joined in the order given, else in that of the least work by row counts and distinct join values. Rows
    carry how many rows of the join so far they stand for; wherever it pays, those equal in all columns that later joins
    need are added up first. The estimates steer work, never results; `sizes` are the caller's, else tables are scanned for them.
    """
    out = None
    for part in q.parts():
        one = _counted_part(tables, q.restricted(part), [a for a in order if a in part] if order else None, broadcast, sizes)
        out = one if out is None else out.crossJoin(one.withColumnRenamed("n", "_n")).select((F.col("n") * F.col("_n")).alias("n"))  # one row each
    return out


def _needed(q: Query, seen: Sequence[str]) -> list[tuple[str, str]]:
    """Columns of the aliases seen that joins with other aliases need."""
    return sorted({x for j in q.joins if not j.aliases <= set(seen) for x in (j.left, j.right) if x[0] in seen})


def _join_sizes(tables: Tables, q: Query) -> Sizes:
    """Rows of each alias and, about, distinct values of its join columns; one job for all."""
    every, columns = None, {a: _needed(q, [a]) for a in q.tables}
    for a in q.tables:
        rows = alias_rows(tables, q, a, [c for _, c in columns[a]])
        one = rows.agg(F.lit(a).alias("a"), F.count("*").alias("rows"), F.array(*(F.approx_count_distinct(f"{a}__{c}") for _, c in columns[a])).alias("values"))
        every = one if every is None else every.union(one)
    found = {r["a"]: r for r in every.collect()}
    return {a: r["rows"] for a, r in found.items()}, {x: max(1, n) for a, r in found.items() for x, n in zip(columns[a], r["values"], strict=True)}


class _Sizes:
    """Estimated rows of joins in an order."""

    def __init__(self, q: Query, rows: dict[str, float], values: dict[tuple[str, str], float]) -> None:
        self.q, self.rows, self.values = q, rows, values

    def groups(self, columns: Sequence[tuple[str, str]]) -> float:
        return math.prod(float(self.values[x]) for x in columns)

    def pays(self, size: float, columns: Sequence[tuple[str, str]]) -> bool:
        return self.groups(columns) <= size / 2

    def one(self, a: str) -> float:
        """Rows of an alias, added up if that pays."""
        columns = _needed(self.q, [a])
        return self.groups(columns) if self.pays(self.rows[a], columns) else float(self.rows[a])

    def step(self, size: float, seen: Sequence[str], a: str) -> tuple[float, float]:
        """Rows when another alias is joined, and of these when they are added up if that pays."""
        made = size * self.one(a)
        for j in self.q.joins:
            if a in j.aliases and len(j.aliases) == 2 and j.aliases - {a} <= set(seen):
                made /= max(self.values[j.left], self.values[j.right])
        columns = _needed(self.q, [*seen, a])
        return made, self.groups(columns) if self.pays(made, columns) else made

    def order(self) -> list[str]:
        """Of least rows read and made, by dynamic programming over connected sets; ties by name."""
        best = {frozenset((a,)): (float(self.rows[a]), self.one(a), [a]) for a in sorted(self.q.tables)}
        for size in range(1, len(self.q.tables)):
            for s in [s for s in best if len(s) == size]:
                cost, rows, seen = best[s]
                for a in sorted(set().union(*(j.aliases for j in self.q.joins if j.aliases & s)) - s):
                    made, left = self.step(rows, seen, a)
                    new = (cost + self.rows[a] + made + left, left, [*seen, a])
                    if s | {a} not in best or new < best[s | {a}]:
                        best[s | {a}] = new
        return best[frozenset(self.q.tables)][2]


def _counted_part(tables: Tables, q: Query, order: Sequence[str] | None, broadcast: Sequence[str], given: Sizes | None) -> DataFrame:
    if len(q.tables) == 1:
        (a,) = q.tables
        own = [x for j in q.joins for x in (j.left, j.right)] or [(a, tables[q.tables[a]].columns[0])]
        return joined(tables, q, own).agg(F.count("*").alias("n"))
    sizes = _Sizes(q, *(given or _join_sizes(tables, q)))
    df, size, seen = None, 0.0, []

    def added(rows: DataFrame, size: float, columns: Sequence[tuple[str, str]], weight: Column) -> DataFrame:
        names = ["__".join(x) for x in columns]
        return rows.groupBy(*names).agg(F.sum(weight).alias("w")) if sizes.pays(size, columns) else rows.select(*names, weight.alias("w"))

    for a in order or sizes.order():
        own = [j for j in q.joins if j.aliases == {a}]
        columns = _needed(q, [a])
        rows = alias_rows(tables, q, a, [*(c for _, c in columns), *(x[1] for j in own for x in (j.left, j.right))])
        for j in own:
            rows = rows.where(F.col("__".join(j.left)) == F.col("__".join(j.right)))
        rows = added(rows, sizes.rows[a], columns, F.lit(1).cast("long"))
        if a in broadcast:
            rows = F.broadcast(rows)
        if df is None:
            df, size = rows, sizes.one(a)
        else:
            on = [F.col("__".join(j.left)) == F.col("__".join(j.right)) for j in q.joins if a in j.aliases and len(j.aliases) == 2 and j.aliases - {a} <= set(seen)]
            rows = rows.withColumnRenamed("w", "_w")
            df = df.join(rows, reduce(Column.__and__, on)) if on else df.crossJoin(rows)
            made, size = sizes.step(size, seen, a)
            if len(seen) + 1 < len(q.tables):
                df = added(df, made, _needed(q, [*seen, a]), F.col("w") * F.col("_w"))
        seen.append(a)
    return df.agg(F.coalesce(F.sum(F.col("w") * F.col("_w")), F.lit(0).cast("long")).alias("n"))


def count(tables: Tables, q: Query, order: Sequence[str] | None = None, broadcast: Sequence[str] = ()) -> int:
    """Rows of the join, as `counted` finds them."""
    return int(counted(tables, q, order, broadcast).first()["n"])


# --- degree sequences


def degrees(df: DataFrame, column: str) -> DataFrame:
    """key, d: rows for each key; null keys never join and are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("d"))


def degree_runs(df: DataFrame, column: str) -> DataFrame:
    """d, n: how many keys have each degree; at most sqrt(2 rows) of them."""
    return degrees(df, column).groupBy("d").agg(F.count("*").alias("n"))


def ranked_degrees(df: DataFrame, column: str) -> DataFrame:
    """d, first, last: the ranks (from 1) of the keys of each degree, largest first, and rows (of all keys up to it).

    The window runs over degree runs, which are few, never over keys.
    """
    w = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = degree_runs(df, column)
    return runs.select("d", "n", F.sum("n").over(w).alias("last"), F.sum(F.col("d") * F.col("n")).over(w).alias("rows")).withColumn("first", F.col("last") - F.col("n") + 1).select("d", "n", "first", "last", "rows")


def max_frequency(df: DataFrame, column: str) -> DataFrame:
    return degrees(df, column).agg(F.max("d").alias("max_frequency"))


def self_join_size(df: DataFrame, column: str) -> DataFrame:
    return degrees(df, column).agg(F.sum(F.col("d") * F.col("d")).alias("self_join_size"))


def star_bound(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """dsb: the degree sequence bound of a join of all tables on one column each.

    Runs of equal degree end at some ranks; between two ends of any table every table has one degree. The windows run
    over these ends, of which there are no more than runs, in linear work.
    """
    every = None
    for i, (df, column) in enumerate(columns):
        ends = ranked_degrees(df, column).select("last", *((F.col("d") if j == i else F.lit(None).cast("long")).alias(f"d{j}") for j in range(len(columns))))
        every = ends if every is None else every.union(ends)
    ends = every.groupBy("last").agg(*(F.max(f"d{j}").alias(f"d{j}") for j in range(len(columns))))
    w = Window.orderBy("last")
    here = [F.first(f"d{j}", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) for j in range(len(columns))]
    weight = (F.col("last") - F.coalesce(F.lag("last").over(w), F.lit(0))).cast("decimal(38,0)")
    for x in here:
        weight = (weight * x).cast("decimal(38,0)")
    return ends.select(weight.alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("dsb"))


# --- joins that statistics and training data need


def foreign_key_join(fk_rows: DataFrame, fk_column: str, key_rows: DataFrame, key_column: str, columns: Sequence[str]) -> DataFrame:
    """Each row of the foreign-key table with some columns of the key it refers to."""
    right = key_rows.select(F.col(key_column).alias("_key"), *columns)
    return fk_rows.join(right, F.col(fk_column) == F.col("_key")).drop("_key")


def fan_out(key_rows: DataFrame, key_column: str, fk_rows: DataFrame, fk_column: str, name: str = "mul") -> DataFrame:
    """key_rows with how many rows refer to each (0 for none), and the same with 1 for none."""
    counts = degrees(fk_rows, fk_column).withColumnRenamed("key", "_key")
    out = key_rows.join(counts, F.col(key_column) == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.coalesce("d", F.lit(0))).withColumn(f"{name}_nn", F.greatest(F.coalesce("d", F.lit(1)), F.lit(1))).drop("d")


def full_outer(fk_rows: DataFrame, fk_column: str, key_rows: DataFrame, key_column: str) -> DataFrame:
    """Rows of both tables, joined where they can be; nulls elsewhere."""
    return fk_rows.join(key_rows, F.col(fk_column) == F.col(key_column), "full_outer")


def full_outer_tree(tables: Tables, keys: Sequence[ForeignKey], root: str, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The FULL OUTER join of root (a key table) with all tables that refer to it, and on down the tree of foreign keys."""
    df = tables[root].select(*columns[root])
    seen = {root}
    while more := [fk for fk in keys if fk.key_table in seen and fk.table not in seen]:
        fk = more[0]
        df = df.join(tables[fk.table].select(*columns[fk.table]), F.col(fk.column) == F.col(fk.key_column), "full_outer")
        seen.add(fk.table)
    return df


def full_join_size(tables: Tables, keys: Sequence[ForeignKey], root: str) -> int:
    """Rows of that join, from measured fan-outs: a row counts as often as its partners below do, at least once, and rows that refer to nothing count too. No join result is made."""

    def weighted(table: str) -> tuple[DataFrame, int]:
        """Rows of a table with w, how many rows of the join each makes; and rows of the join that hold none of the table."""
        df, orphans = tables[table].withColumn("w", F.lit(1).cast("long")), 0
        for fk in (fk for fk in keys if fk.key_table == table):
            below, lost = weighted(fk.table)
            orphans += lost
            sums = below.groupBy(F.col(fk.column).alias("below_key")).agg(F.sum("w").alias("below_w"))
            orphans += sums.join(tables[table].select(fk.key_column), F.col("below_key") == F.col(fk.key_column), "left_anti").agg(F.sum("below_w")).first()[0] or 0
            df = df.join(sums, F.col(fk.key_column) == F.col("below_key"), "left").withColumn("w", F.col("w") * F.coalesce("below_w", F.lit(1))).drop("below_key", "below_w")
        return df, orphans

    df, orphans = weighted(root)
    return int((df.agg(F.sum("w")).first()[0] or 0) + orphans)


def unmatched(rows: DataFrame, column: str, others: DataFrame, other_column: str) -> DataFrame:
    """Rows without a join partner."""
    return rows.join(others.select(F.col(other_column).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def matched(rows: DataFrame, column: str, others: DataFrame, other_column: str) -> DataFrame:
    return rows.join(others.select(F.col(other_column).alias("_k")), F.col(column) == F.col("_k"), "left_semi")


def distributed_ranks(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """value, n, last: each value, how often it occurs, and the rank of its last occurrence in the whole order.

    Values are counted, range-partitioned and summed within partitions, so no task holds the whole order; the
    partitions' totals, one row each, are summed by a window and joined. Which value lies in which partition is kept in
    files where spark.checkpoint.dir names a shared folder, so a lost executor can't change it; else in the cache.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = _kept(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each partition
    totals = placed.groupBy("part").agg(F.sum("n").alias("total")).select("part", (F.sum("total").over(w) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("within", within).join(F.broadcast(totals), "part").select("value", "n", (F.col("before") + F.col("within")).alias("last"))


def _kept(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint(eager=True)
    return df.persist()


def distinct_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """edge: all different values if there are no more than bins; else the different quantile edges, and the most common other values (ties: the least) up to bins."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("edge")).agg(F.count("*").alias("n"))
    if counts.limit(bins + 1).count() <= bins:
        return counts.select("edge")
    edges = F.broadcast(quantile_edges(df, column, bins).select("edge").distinct())  # bins rows at most
    more = counts.join(edges, "edge", "left_anti").orderBy(F.desc("n"), "edge").limit(max(0, bins - edges.count()))
    return edges.union(more.select("edge"))


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """i, edge for i in 1..bins: the value at index floor(rows * i / (bins + 1)) of the sorted column."""
    ranks = distributed_ranks(df, column)
    total = F.lit(ranks.agg(F.sum("n")).first()[0] or 0)
    wanted = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("i"), F.floor(total * F.col("id") / (bins + 1)).alias("at"))
    hit = F.broadcast(wanted)  # one row for each bin
    return ranks.join(hit, (F.col("at") < F.col("last")) & (F.col("at") >= F.col("last") - F.col("n"))).select("i", F.col("value").alias("edge"))
