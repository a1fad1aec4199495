"""Building statistics: degree functions of join columns, of all rows and of the rows that a filter value selects.

One plan serves every kind of condition and all filter columns of a table, or all that one foreign key reaches, with one
join for the key. Values are counted first, which gives the buckets (common values, the intervals of a dyadic histogram,
common substrings, null or not null). Then rows are dealt by each join column's keys, and the tasks that hold all rows of
their keys count the degrees in every bucket (`keyed`); for the key column itself a row for each key will do. Where it is
told what will be looked up, filter columns with few values, or of which only ranges are looked up, are worked on in a few
cells instead (`cells`). Filter columns of other types, and texts of more than DICTIONARY values, are counted by (filter column, join column, key, filter
value) in a shuffle instead. Runs of one bucket become a step function of at most 100 segments where they are, and only
these reach the driver.
"""

from __future__ import annotations

import datetime
import math
from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.step import ZERO, Step, cluster, compress, maximum, minimum, total
from ..functions.text import GRAM, grams, pattern_grams
from ..model import ForeignKey, Schema
from ..plans.query import AnyOf, Predicate
from . import cells, keyed
from .exact import degree_runs, foreign_key_join

ROWS = "*"  # the column that counts rows: one key for all
#: Different values of a text filter column that tasks are told of.
DICTIONARY = 50_000
#: Tables and foreign keys of more rows are worked on one at a time, so that their shuffles aren't needed at once.
LARGE = 4_000_000


@dataclass(frozen=True)
class Options:
    error: float = 0.01
    buckets: int = 32
    common_values: int = 500
    groups: int = 32
    common_grams: int = 500
    track_nulls: bool = True
    track_grams: bool = True
    strategy: str = "relative"
    mode: str = "cdf"
    linkage: str = "complete"
    #: Values (of least hash) from which interval edges are taken; edges steer tightness, never safety.
    edge_sample: int = 20_000
    #: Tables and foreign keys that are worked on at a time.
    jobs: int = 8


Functions = dict[str, Step]  # by join column


@dataclass
class Interval:
    """Values above low (None: all) up to and with high (None: all)."""

    low: object
    high: object
    functions: Functions

    def covers(self, low, low_open: bool, high) -> bool:
        below = self.low is None or (low is not None and (self.low < low or (low_open and self.low == low)))
        return below and (self.high is None or (high is not None and high <= self.high))


def pointwise(parts: list[Functions], how) -> Functions:
    columns = set().union(*parts) if parts else set()
    return {c: how([p.get(c, ZERO) for p in parts]) for c in columns}


@dataclass
class FilterStats:
    """What is known of a table's join columns given one filter column (its own, or that of a key it refers to)."""

    kind: str  # of the filter column, as Spark names it
    not_null: Functions
    null: Functions | None = None
    intervals: list[Interval] = field(default_factory=list)
    common: dict[object, int] = field(default_factory=dict)
    groups: list[Functions] = field(default_factory=list)
    rest: Functions = field(default_factory=dict)
    common_grams: dict[str, int] | None = None
    gram_groups: list[Functions] = field(default_factory=list)
    gram_rest: Functions = field(default_factory=dict)
    singles: bool = True  # whether single values are known of

    def value(self, v):
        """A literal as the column's values are."""
        if isinstance(v, str) and self.kind.startswith("timestamp"):
            return datetime.datetime.fromisoformat(v)
        if isinstance(v, str) and self.kind == "date":
            return datetime.date.fromisoformat(v)
        if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) and self.kind.startswith("timestamp"):
            return datetime.datetime(v.year, v.month, v.day)
        if isinstance(v, str) and self.kind != "string":
            return float(v)
        if not isinstance(v, str) and self.kind == "string":
            return str(v)
        return v

    def between(self, low, low_open: bool, high) -> Functions:
        return pointwise([i.functions for i in self.intervals if i.covers(low, low_open, high)] + [self.not_null], minimum)

    def equal(self, v) -> Functions:
        hit = (self.groups[self.common[v]] if v in self.common else self.rest) if self.singles else self.not_null
        return pointwise([hit, self.between(v, False, v)], minimum)

    def like(self, pattern: str) -> Functions:
        if not any(c in pattern for c in "%_\\"):
            return self.equal(pattern)
        wanted = pattern_grams(pattern) if self.common_grams is not None else []
        found = [self.gram_groups[self.common_grams[g]] if g in self.common_grams else self.gram_rest for g in wanted]
        return pointwise([*found, self.not_null], minimum)

    def one(self, p: Predicate) -> Functions | None:
        """Functions of the rows that satisfy one predicate; None if nothing is known of it."""
        if p.op == "IS NULL":
            return self.null
        if p.op in ("IS NOT NULL", "!=", "NOT LIKE", "NOT IN"):
            return self.not_null
        if p.op == "LIKE":
            return self.like(p.value)
        if p.op == "IN":
            values = list(dict.fromkeys(self.value(v) for v in p.value if v is not None))
            if not values:
                return {}
            return pointwise([pointwise([self.equal(v) for v in values], total), self.between(min(values), False, max(values))], minimum)
        if p.op == "=":
            return {} if p.value is None else self.equal(self.value(p.value))
        return self.range([p])

    def range(self, predicates: list[Predicate]) -> Functions:
        """Of several range predicates at once."""
        low = high = None
        low_open = high_open = False
        for p in predicates:
            for op, v in ((">=", p.value[0]), ("<=", p.value[1])) if p.op == "BETWEEN" else ((p.op, p.value),):
                if v is None:
                    return {}
                v = self.value(v)
                if op in (">", ">=") and (low is None or v > low or (v == low and op == ">")):
                    low, low_open = v, op == ">"
                if op in ("<", "<=") and (high is None or v < high or (v == high and op == "<")):
                    high, high_open = v, op == "<"
        if low is not None and high is not None and (low > high or (low == high and (low_open or high_open))):
            return {}
        return self.between(low, low_open, high)

    def all_of(self, predicates: list[Predicate]) -> Functions | None:
        ranges = [p for p in predicates if p.op in ("<", "<=", ">", ">=", "BETWEEN")]
        parts = [self.one(p) for p in predicates if p not in ranges] + ([self.range(ranges)] if ranges else [])
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
        return {} if any(not p for p in parts) else pointwise(parts, minimum)

    def memory(self) -> int:
        every = [self.not_null, self.null or {}, self.rest, self.gram_rest, *self.groups, *self.gram_groups, *(i.functions for i in self.intervals)]
        return sum(f.memory() for fs in every for f in fs.values()) + 16 * (len(self.common) + len(self.common_grams or ()))


@dataclass
class TableStats:
    full: Functions
    filters: dict[tuple[str, ...], FilterStats] = field(default_factory=dict)  # (column,) or (own fk column, key table, its column)

    def functions(self, conditions: list[tuple[tuple[str, ...], Predicate | AnyOf]]) -> Functions:
        """Functions of the rows that satisfy all conditions; a condition of which nothing is known is left out."""
        parts = [self.full]
        by: dict[tuple[str, ...], list[Predicate]] = {}
        for key, p in conditions:
            if isinstance(p, AnyOf):
                own = [self.filters[(*key[:-1], x.column)].one(x) if (*key[:-1], x.column) in self.filters else None for x in p.parts]
                if all(x is not None for x in own):
                    parts.append(pointwise([self._all(x) for x in own], total))
            elif key in self.filters:
                by.setdefault(key, []).append(p)
        for key, predicates in by.items():
            found = self.filters[key].all_of(predicates)
            if found is not None:
                parts.append(self._all(found))
        out = pointwise(parts, minimum)
        rows = out.get(ROWS, ZERO).total
        return {c: f.cap(rows) for c, f in out.items()}

    def _all(self, f: Functions) -> Functions:
        return {c: f.get(c, ZERO) for c in self.full}


@dataclass(frozen=True)
class Need:
    """What of a table's statistics is asked for: functions of some join columns, given some filters (keys as in TableStats).

    lookups: filters with what is looked up of them beside ranges and nulls, EQUAL or LIKE; None: anything.
    """

    columns: frozenset[str]
    filters: frozenset[tuple[str, ...]]
    lookups: frozenset[tuple[tuple[str, ...], str]] | None = field(default=None, compare=False)

    def covers(self, other: Need) -> bool:
        told = self.lookups is None or (other.lookups is not None and self.lookups >= other.lookups)
        return told and self.columns >= other.columns and self.filters >= other.filters


EQUAL, LIKE = "equal", "like"


def looked_up(p: Predicate) -> str | None:
    """What a predicate looks up beside ranges and nulls."""
    if p.op == "LIKE" and any(c in p.value for c in "%_\\"):
        return LIKE
    return EQUAL if p.op in ("=", "IN", "LIKE") else None


@dataclass
class Statistics:
    schema: Schema
    tables: dict[str, TableStats]
    options: Options

    def memory(self) -> int:
        return sum(sum(f.memory() for f in t.full.values()) + sum(s.memory() for s in t.filters.values()) for t in self.tables.values())


# --- the distributed part


def pair_counts(rows: DataFrame, join_columns: tuple[str, ...], filter_column: str | None) -> DataFrame:
    """column, key, f, n: rows for each key of each join column and each filter value; column '*' has one key."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in join_columns]
    pairs.append(F.struct(F.lit(ROWS).alias("column"), F.lit(ROWS).alias("key")))
    f = F.col(filter_column) if filter_column else F.lit(None).cast("string")
    each = rows.select(f.alias("f"), F.explode(F.array(*pairs)).alias("p")).select("f", "p.column", "p.key").where("key is not null")
    return each.groupBy("column", "key", "f").agg(F.count("*").alias("n"))


def bucket_runs(counts: DataFrame) -> DataFrame:
    """counts: bucket, column, key, n (to be added up). bucket, column, d, n: keys with each degree in each bucket."""
    sums = counts.groupBy("bucket", "column", "key").agg(F.sum("n").alias("d"))
    return sums.groupBy("bucket", "column", "d").agg(F.count("*").alias("n"))


def rank_maximum(counts: DataFrame, value: str) -> DataFrame:
    """counts: column, key, n and a value. column, d, n: runs of the sequence whose r-th degree is the largest r-th degree of any value."""
    return bucket_rank_maximum(counts.select(F.lit("").alias("bucket"), "column", "key", F.col(value).alias("value"), "n")).select("column", "d", "n")


def common_values(rows: DataFrame, column: str, most: int) -> DataFrame:
    """value, n of the most common values; ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def base_bucket(value, edges: list):
    """Number of edges below the value; dates and times as literals of the session's time zone."""
    of = lambda e: F.lit(str(e)).cast("timestamp" if isinstance(e, datetime.datetime) else "date") if isinstance(e, datetime.date) else F.lit(e)
    return F.size(F.filter(F.array(*map(of, edges)), lambda e: e < value)) if edges else F.lit(0)


def interval_names(base, levels: int):
    """Names level:shift:index of the dyadic intervals that hold a base bucket; from level 2 on also the half-shifted ones."""
    out = []
    for k in range(levels):
        out.append(F.concat(F.lit(f"{k}:0:"), F.shiftright(base, k).cast("string")))
        if k >= 2:
            out.append(F.concat(F.lit(f"{k}:1:"), F.shiftright(base + (1 << (k - 1)), k).cast("string")))
    return F.array(*out)


def interval_ends(name: str, edges: list) -> tuple:
    k, shift, i = map(int, name.split(":"))
    first = (i << k) - (shift << (k - 1) if shift else 0)
    last = first + (1 << k)
    return (edges[first - 1] if 0 < first else None, edges[last - 1] if last <= len(edges) else None)


def as_text(df: DataFrame, column: str):
    """A column's values as strings that are equal where the values are, and in which `parsed` finds them again."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if kind in ("float", "double"):
        c = c.cast("double") + F.lit(0.0)  # one zero
    elif kind.startswith("decimal"):
        c = c.cast("double")
    return c.cast("string")


def typed(kind: str) -> str:
    """The type in which values of a kind are compared."""
    return "double" if kind == "float" or kind.startswith("decimal") else kind


def parsed(text: str | None, kind: str):
    """The value that `as_text` has made a string of."""
    if text is None or kind == "string":
        return text
    if kind.startswith("timestamp"):
        return datetime.datetime.fromisoformat(text)
    if kind == "date":
        return datetime.date.fromisoformat(text)
    if kind == "boolean":
        return text == "true"
    return float(text) if typed(kind) == "double" else int(text)


def column_counts(rows: DataFrame, join_columns: tuple[str, ...], filters: tuple[str, ...]) -> DataFrame:
    """i, column, key, f, n: rows for each key of each join column and each value (as text) of the i-th filter column."""
    values = F.array(*(F.named_struct(F.lit("i"), F.lit(i), F.lit("f"), as_text(rows, c)) for i, c in enumerate(filters)))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in join_columns]
    pairs.append(F.struct(F.lit(ROWS).alias("column"), F.lit(ROWS).alias("key")))
    each = rows.select(values.alias("v"), F.explode(F.array(*pairs)).alias("p")).where("p.key is not null").select("p.column", "p.key", F.explode("v").alias("v"))
    return each.groupBy("v.i", "column", "key", "v.f").agg(F.count("*").alias("n"))


def _listed(spark: SparkSession, lists: list[list[str]]) -> DataFrame:
    """i, v, at: the values listed for each filter column, and their places; Options bound how many they are."""
    made = [(i, v, at) for i, values in enumerate(lists) for at, v in enumerate(values)]
    return F.broadcast(spark.createDataFrame(made, "i int, v string, at int"))


def _name(kind: str, *more):
    return F.concat_ws(" ", F.col("i").cast("string"), F.lit(kind), *more)


def _runs(rows: DataFrame, bucket, degree: str = "n") -> DataFrame:
    """bucket, column, d, n of rows that hold one key's degree in one bucket each."""
    return rows.groupBy(bucket.alias("bucket"), "column", F.col(degree).alias("d")).agg(F.count("*").alias("n"))


def interval_list(edges: list) -> list[tuple[str, int, int]]:
    """name, first and last base bucket of every dyadic interval that holds one."""
    out, levels = [], max(1, math.ceil(math.log2(len(edges) + 1)))
    for k in range(levels):
        for shift in (0, 1) if k >= 2 else (0,):
            offset = 1 << (k - 1) if shift else 0
            for i in range(((len(edges) + offset) >> k) + 1):
                out.append((f"{k}:{shift}:{i}", max(0, (i << k) - offset), min(len(edges), (i << k) - offset + (1 << k) - 1)))
    return out


def gram_sets(values: DataFrame, complete: list[int]) -> list[dict[str, frozenset[str]]]:
    """values: i, v. For each of some filter columns all of whose values are few, the values that hold each gram."""
    found: dict[int, dict[str, set[str]]] = {i: {} for i in complete}
    for r in values.where(F.col("i").isin(*complete)).select("i", "v", F.explode(grams(F.col("v"))).alias("g")).collect() if complete else []:
        found[r["i"]].setdefault(r["g"], set()).add(r["v"])
    return [{g: frozenset(v) for g, v in found.get(i, {}).items()} for i in range(max(complete, default=-1) + 1)]


def conditioned_runs(counts: DataFrame, kinds: list[str], common: list[list[str]], edges: list[list], top_grams: list[list[str]], options: Options, same: list[dict[str, str]] | None = None) -> DataFrame:
    """bucket, column, d, n over every kind of bucket; a bucket's name begins with the number of the filter column.

    A row of counts is a key's degree for one value, so that single values, nulls and rare values need no further sums.
    Degrees in intervals and of all values are sums over base buckets, which one shuffle by key makes. `same` tells for
    each filter column which grams other buckets stand for.
    """
    spark, base = counts.sparkSession, counts.where("f is not null")
    out = [_runs(counts.where("f is null"), _name("null"))] if options.track_nulls else []
    bucket, names = F.lit(0), F.array().cast("array<struct<name:string,d:bigint>>")
    bins = max((len(own) + 1 for own in edges if own), default=1)
    for i, (kind, own) in enumerate(zip(kinds, edges, strict=True)):
        if own:
            bucket = F.when(F.col("i") == i, base_bucket(F.col("f").cast(typed(kind)), own)).otherwise(bucket)
            inside = [F.struct(F.lit(f"interval {name}").alias("name"), sum((F.col(f"s{j}") for j in range(first + 1, last + 1)), F.col(f"s{first}")).alias("d")) for name, first, last in interval_list(own) if first <= last]
            names = F.when(F.col("i") == i, F.array(*inside)).otherwise(names)
    sums = [F.sum(F.when(F.col("b") == j, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(f"s{j}") for j in range(bins)]
    rolled = base.withColumn("b", bucket).groupBy("i", "column", "key").agg(F.sum("n").alias("n"), *sums)
    whole = F.array(F.struct(F.lit("not null").alias("name"), F.col("n").alias("d")))
    each = rolled.select("i", "column", F.explode(F.filter(F.concat(whole, names), lambda x: x["d"] > 0)).alias("x")).select("i", "column", "x.name", "x.d")
    out.append(each.groupBy("i", "name", "column", "d").agg(F.count("*").alias("n")).select(F.concat_ws(" ", F.col("i").cast("string"), "name").alias("bucket"), "column", "d", "n"))
    hit = base.join(_listed(spark, common).withColumnRenamed("v", "f"), ["i", "f"], "left")
    out.append(_runs(hit.where("at is not null"), _name("value", F.col("at").cast("string"))))
    out.append(rank_maximum_of(hit.where("at is null").select(_name("rest").alias("bucket"), "column", F.col("f").alias("value"), F.col("n").alias("c"))))
    texts = [i for i, kind in enumerate(kinds) if kind == "string"]
    if options.track_grams and texts:
        listed = [[g for g in own if not (same and g in same[i])] for i, own in enumerate(top_grams)]
        at = {(i, g): k for i, own in enumerate(top_grams) for k, g in enumerate(own)}
        places = F.broadcast(spark.createDataFrame([(i, g, at[i, g] if g in listed[i] else None) for i, own in enumerate(top_grams) for g in own], "i int, v string, at int"))
        each = base.where(F.col("i").isin(*texts)).select("i", "column", "key", "n", F.explode(grams(F.col("f"))).alias("v")).join(places.withColumn("known", F.lit(True)), ["i", "v"], "left")
        out.append(bucket_runs(each.where("at is not null").select(_name("gram", F.col("at").cast("string")).alias("bucket"), "column", "key", "n")))
        out.append(bucket_rank_maximum(each.where("known is null").select(_name("gram rest").alias("bucket"), "column", "key", F.col("v").alias("value"), "n")))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def bucket_rank_maximum(counts: DataFrame) -> DataFrame:
    """counts: bucket, column, key, value, n. bucket, column, d, n: runs of the sequence whose r-th degree is the largest r-th degree of any value of the bucket.

    Of a value's keys only runs of equal degree are ranked, so that no value's keys are one task's work.
    """
    return rank_maximum_of(counts.groupBy("bucket", "column", "value", "key").agg(F.sum("n").alias("c")))


def rank_maximum_of(sums: DataFrame) -> DataFrame:
    """The same of sums that are made: bucket, column, value and c, a row for each key."""
    runs = sums.groupBy("bucket", "column", "value", "c").agg(F.count("*").alias("m"))
    last = F.sum("m").over(Window.partitionBy("bucket", "column", "value").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the degree at rank r is the largest degree of any value whose runs reach r
    return reach_maximum(runs.withColumn("r", last))


def reach_maximum(reaches: DataFrame) -> DataFrame:
    """bucket, column, d, n of reaches: bucket, column, c and r, a value's keys of at least that degree."""
    reach = reaches.groupBy("bucket", "column", "r").agg(F.max("c").alias("c"))
    back = Window.partitionBy("bucket", "column").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = reach.select("bucket", "column", "r", F.max("c").over(back).alias("d"))
    before = F.lag("r", 1, 0).over(Window.partitionBy("bucket", "column").orderBy("r"))
    return ends.withColumn("n", F.col("r") - before).groupBy("bucket", "column", "d").agg(F.sum("n").alias("n"))


def step_functions(runs: DataFrame, options: Options, error: float | dict[str, float] | None = None, totals: dict[str, int] | None = None) -> dict[str, Functions]:
    """By bucket; runs of one bucket and column are few, and are compressed where they are. totals: gets the rows of each bucket."""
    closer, strategy, mode = error if isinstance(error, dict) else {}, options.strategy, options.mode
    eps = error if isinstance(error, float) else options.error

    def make(batches):
        for b in batches:
            made = [compress([x["d"] for x in own], [x["n"] for x in own], closer.get(bucket, eps), strategy, mode).arrays() for bucket, own in zip(b.column("bucket").to_pylist(), b.column("runs").to_pylist(), strict=True)]
            edges, slopes = (pa.array([list(x[k]) for x in made], pa.list_(pa.float64())) for k in (0, 1))
            rows = pa.array([sum(x["d"] * x["n"] for x in own) for own in b.column("runs").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("column"), edges, slopes, rows], ["bucket", "column", "edges", "slopes", "rows"])

    out: dict[str, Functions] = {}
    lists = runs.groupBy("bucket", "column").agg(F.sort_array(F.collect_list(F.struct("d", "n")), asc=False).alias("runs"))
    for r in lists.mapInArrow(make, "bucket string, column string, edges array<double>, slopes array<double>, rows long").collect():
        if totals is not None:
            totals[r["bucket"]] = r["rows"]
        out.setdefault(r["bucket"], {})[r["column"]] = Step(np.array(r["edges"]), np.array(r["slopes"]))
    return out


def _grouped(functions: list[Functions], options: Options) -> tuple[list[int], list[Functions]]:
    """Group of each, and the groups' functions."""
    scores = [sum(f.self_join() for f in fs.values()) for fs in functions]
    labels = cluster(scores, options.groups, options.linkage)
    made = []
    for g in range(max(labels, default=-1) + 1):
        made.append(pointwise([functions[i] for i, x in enumerate(labels) if x == g], maximum))
    return labels, made


def _top(counts: DataFrame, most: int, columns: int) -> list[list[str]]:
    """counts: i, v, n. For each filter column its `most` values of greatest n; ties by value."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    found: list[list[str]] = [[] for _ in range(columns)]
    for r in counts.withColumn("r", rank).where(F.col("r") <= most).orderBy("i", "r").collect():
        found[r["i"]].append(r["v"])
    return found


def _same_grams(top: list[list[str]], common: list[list[str]], sets: list[dict[str, frozenset[str]]], columns: int) -> list[dict[str, str]]:
    """For each filter column, grams whose rows are those of another bucket, and its name: that of one value, of all, or of an earlier gram."""
    out: list[dict[str, str]] = [{} for _ in range(columns)]
    for i, own in enumerate(sets):
        names = {frozenset((v,)): f"value {k}" for k, v in enumerate(common[i])}
        names.setdefault(frozenset(common[i]), "not null")
        for k, g in enumerate(top[i]):
            if own.get(g) in names:
                out[i][g] = names[own[g]]
            elif g in own:
                names[own[g]] = f"gram {k}"
    return out


def code_columns(df: DataFrame, column: str) -> tuple[str, Column | None, Column | None] | None:
    """How tasks see a filter column (text, double or long), and what they compare: a long or a double. None for other types."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if kind == "string":
        return "text", None, None
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "double", None, c.cast("double") + F.lit(0.0)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "long", c.cast("long"), None
    if kind == "boolean":
        return "long", c.cast("int").cast("long"), None
    if kind == "date":
        return "long", F.unix_date(c).cast("long"), None
    if kind == "timestamp":
        return "long", F.unix_micros(c), None
    if kind == "timestamp_ntz":  # as it reads, in no time zone
        seconds = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
        return "long", seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"), None
    return None


def key_code(df: DataFrame, column: str) -> Column:
    """Keys as longs; those of other types by hash, which can make two keys one and a bound larger, never smaller."""
    c = F.col(column)
    return c.cast("long") if df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def _key_numbers(rows: DataFrame, columns: tuple[str, ...]) -> dict[str, int]:
    """About how many keys columns have; steers how many parts there are."""
    return {c: n or 0 for c, n in zip(columns, rows.agg(*(F.approx_count_distinct(c).alias(f"n{k}") for k, c in enumerate(columns))).first(), strict=True)} if columns else {}


@dataclass
class Keys:
    """A row for each key of one join column: `column`, the filter columns, n, and n0, n1, ... of its rows those in which each join column isn't null.

    counts: the same without filter columns, also of keys that refer to nothing.
    """

    column: str
    rows: DataFrame
    counts: DataFrame


def filter_statistics(rows: DataFrame, join_columns: tuple[str, ...], filters: tuple[str, ...], options: Options, keys: Keys | None = None, numbers: dict[str, int] | None = None) -> list[FilterStats]:
    """Statistics of the join columns given each of some filter columns of the same rows.

    keys: the same by key, where a join column's key tells the filter columns; numbers: about how many keys there are.
    """
    coded = {c: code_columns(rows, c) for c in filters}
    plain = tuple(c for c in filters if coded[c] is not None)
    found: dict[str, FilterStats] = {}
    if plain:
        found = _keyed_statistics(rows, join_columns, plain, options, keys, numbers)
    rest = tuple(c for c in filters if c not in found)
    if rest:
        found |= dict(zip(rest, spread_statistics(rows, join_columns, rest, options), strict=True))
    return [found[c] for c in filters]


def _value_counts(source: DataFrame, filters: tuple[str, ...], counts: list[Column]) -> DataFrame:
    """i, f, b, x, n, n0, n1, ...: rows of each value, and those with a key in each join column."""
    each = []
    for i, c in enumerate(filters):
        _, b, x = code_columns(source, c)
        each.append(F.named_struct(F.lit("i"), F.lit(i), F.lit("f"), as_text(source, c), F.lit("b"), F.lit(None).cast("long") if b is None else b, F.lit("x"), F.lit(None).cast("double") if x is None else x))
    names = ["n", *(f"n{k}" for k in range(len(counts) - 1))]
    rows = source.select(F.explode(F.array(*each)).alias("v"), *(c.alias(name) for c, name in zip(counts, names, strict=True)))
    return rows.groupBy("v.i", "v.f", "v.b", "v.x").agg(*(F.sum(name).alias(name) for name in names))


def _text_grams(text: str) -> list[str]:
    return list(dict.fromkeys(text[k : k + GRAM] for k in range(len(text) - GRAM + 1)))


def _quantiles(values: list[tuple], bins: int) -> list[int]:
    """Places of the different quantile edges among sorted (value, rows)."""
    upto = list(accumulate(n for _, n in values))
    return sorted({bisect_right(upto, upto[-1] * j // (bins + 1)) for j in range(1, bins + 1)}) if values else []


def _keyed_statistics(rows: DataFrame, join_columns: tuple[str, ...], filters: tuple[str, ...], options: Options, keys: Keys | None, numbers: dict[str, int] | None) -> dict[str, FilterStats]:
    """Those of the filter columns of which tasks can be told all they need: not of texts with more than DICTIONARY values."""
    spark = rows.sparkSession
    if keys:
        values = _value_counts(keys.rows, filters, [F.col("n"), *(F.col(f"n{k}") for k in range(len(join_columns)))]).persist()
    else:
        values = _value_counts(rows, filters, [F.lit(1).cast("long"), *(F.col(c).isNotNull().cast("long") for c in join_columns)]).persist()
    counts = None
    try:
        sizes = {r["i"]: r["values"] for r in values.where("f is not null").groupBy("i").agg(F.count("*").alias("values")).collect()}
        total = values.where("i = 0").agg(*(F.sum(f"n{k}") for k in range(len(join_columns)))).first() if join_columns else ()
        kinds = [code_columns(rows, c)[0] for c in filters]
        bins = 2 ** max(0, math.ceil(math.log2(max(1, options.buckets)))) - 1
        types = [rows.schema[c].dataType.simpleString() for c in filters]
        use = [i for i, kind in enumerate(kinds) if kind != "text" or sizes.get(i, 0) <= DICTIONARY]
        if not use:
            return {}
        made: list[keyed.Filter] = []
        common: dict[int, list[str]] = {}
        edges: dict[int, list] = {}
        top: dict[int, list[str]] = {}
        same: dict[int, dict[str, str]] = {}
        some = values.where("f is not null")
        listed = {i: [] for i in use}
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "f"))
        for r in some.where(F.col("i").isin(*use)).withColumn("r", rank).where(F.col("r") <= options.common_values).orderBy("i", "r").select("i", "f", "b", "x").collect():
            listed[r["i"]].append(r)
        for i in use:
            common[i] = [r["f"] for r in listed[i]]
            if kinds[i] == "text":
                texts = sorted(((r["f"], r["n"]) for r in some.where(F.col("i") == i).select("f", "n").collect()))
                at = _quantiles(texts, bins)
                edges[i] = [texts[k][0] for k in at]
                place = {t: k for k, (t, _) in enumerate(texts)}
                one = keyed.Filter("text", edges[i], [], list(place), [place[v] for v in common[i]])
                if options.track_grams:
                    own = [_text_grams(t) for t, _ in texts]
                    often: dict[str, int] = {}
                    for gs, (_, n) in zip(own, texts, strict=True):
                        for g in gs:
                            often[g] = often.get(g, 0) + n
                    top[i] = sorted(often, key=lambda g: (-often[g], g))[: options.common_grams]
                    if len(texts) == len(common[i]):
                        sets: dict[str, set[str]] = {}
                        for gs, (t, _) in zip(own, texts, strict=True):
                            for g in gs:
                                sets.setdefault(g, set()).add(t)
                        (same[i],) = _same_grams([top[i]], [common[i]], [{g: frozenset(v) for g, v in sets.items()}], 1)
                    else:
                        same[i] = {}
                    known, counted = set(top[i]), {g: k for k, g in enumerate(top[i]) if g not in same[i]}
                    rare = {g: k for k, g in enumerate(sorted(set(often) - known))}
                    one.gram_lists = keyed.Lists.of([[counted[g] for g in gs if g in counted] for gs in own])
                    one.rare_lists = keyed.Lists.of([[rare[g] for g in gs if g in rare] for gs in own]) if rare else None
            else:
                number = "x" if kinds[i] == "double" else "b"
                sample = some.where(F.col("i") == i).orderBy(F.xxhash64("f"), "f").limit(options.edge_sample).select("f", number, "n").collect()
                sample = sorted(((r[number], r["n"], r["f"]) for r in sample if r[number] == r[number]), key=lambda r: r[0])
                at = _quantiles([(v, n) for v, n, _ in sample], bins) if types[i] != "boolean" else []
                edges[i] = [parsed(sample[k][2], types[i]) for k in at]
                one = keyed.Filter(kinds[i], [sample[k][0] for k in at], [], common=[r[number] for r in listed[i]])
            one.intervals = [(first, last) for _, first, last in interval_list(edges[i]) if first <= last] if edges[i] else []
            made.append(one)
        if numbers is None:
            numbers = _key_numbers(rows, join_columns)
        least, parts, before = 2 * spark.sparkContext.defaultParallelism, [], 0
        for k, c in enumerate(join_columns):
            held = numbers.get(c, 0) if keys and c == keys.column else total[k] or 0
            n = max(1, min(-(-held // keyed.PART_ROWS), max(least, numbers.get(c, 0) // 1000)))
            parts.append((k, before, n))
            before += n
        own = [p for p in parts if not keys or join_columns[p[0]] != keys.column]
        chosen = [filters[i] for i in use]
        typed_of = lambda df: [next(x for x in (*code_columns(df, c)[1:], F.col(c)) if x is not None).alias(f"f{k}") for k, c in enumerate(chosen)]
        deals = []
        if own:
            deals.append(rows.select(*(key_code(rows, join_columns[k]).alias(f"k{k}") for k, _, _ in own), F.lit(1).cast("long").alias("n"), *typed_of(rows)).mapInArrow(keyed.dealt(made, own), "part int, blob binary"))
        if len(own) < len(parts):
            deals.append(keys.rows.select(key_code(keys.rows, keys.column).alias("k"), "n", *typed_of(keys.rows)).mapInArrow(keyed.dealt(made, [p for p in parts if p not in own]), "part int, blob binary"))
        if deals:
            blobs = deals[0] if len(deals) == 1 else deals[0].union(deals[1])
            counts = blobs.repartitionById(before, "part").mapInArrow(keyed.counted(made), keyed.RESULT).groupBy("what", "i", "c", "b", "x", "d").agg(F.sum("n").alias("n")).persist()
            name = lambda *more: F.concat_ws(" ", F.col("i").cast("string"), *more)
            runs = counts.where(F.col("what") == keyed.BUCKET).select(name(F.col("b").cast("string")).alias("bucket"), F.col("c").cast("string").alias("column"), "d", "n")
            functions = step_functions(runs.union(_rare_runs(values, counts, made, use, common, len(join_columns))), options)
        else:
            functions = {}
        sums: dict[tuple[int, int, int], int] = {}
        place = F.create_map(*(F.lit(x) for p in enumerate(use) for x in reversed(p)))
        for r in values.where(F.col("i").isin(*use)).select(place[F.col("i")].cast("int").alias("i"), "f", "b", "x", "n").mapInArrow(keyed.row_sums(made), "what int, i int, b long, n long").groupBy("what", "i", "b").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect():
            sums[r["what"], r["i"], r["b"]] = r["most"] if r["what"] == 3 else r["n"]
    finally:
        values.unpersist()
        if counts is not None:
            counts.unpersist()
    out = {}
    for j, i in enumerate(use):
        f = made[j]

        def functions_of(bucket, rows_held: int | None, j=j) -> Functions:
            found = {join_columns[int(c)]: g for c, g in functions.get(f"{j} {bucket}", {}).items()}
            if rows_held:
                found[ROWS] = compress([rows_held], [1], options.error, options.strategy, options.mode)
            return found

        bases = [sums.get((1, j, b), 0) for b in range(len(edges[i]) + 1)]
        s = FilterStats(types[i], functions_of(keyed.NOT_NULL, sum(bases)), functions_of(keyed.NULL, sums.get((0, j, keyed.NULL))) if options.track_nulls else None)
        names = [x for x, first, last in interval_list(edges[i]) if first <= last] if edges[i] else []
        for k, (x, (first, last)) in enumerate(zip(names, f.intervals, strict=True)):
            if n := sum(bases[first : last + 1]):
                s.intervals.append(Interval(*interval_ends(x, edges[i]), functions_of(keyed.FIRST + k, n)))
        of_value = {f"value {k}": functions_of(f.first_value + k, sums.get((2, j, k))) for k in range(len(common[i]))}
        labels, s.groups = _grouped(list(of_value.values()), options)
        s.common = dict(zip((parsed(v, types[i]) for v in common[i]), labels, strict=True))
        s.rest = functions_of("rest", sums.get((3, j, 0)))
        if i in top:
            known = {**of_value, "not null": s.not_null, **{f"gram {k}": functions_of(f.first_gram + k, sums.get((4, j, k))) for k, g in enumerate(top[i]) if g not in same[i]}}
            labels, s.gram_groups = _grouped([known[same[i].get(g, f"gram {k}")] for k, g in enumerate(top[i])], options)
            s.common_grams = dict(zip(top[i], labels, strict=True))
            s.gram_rest = functions_of("gram rest", max((n for (what, at, _), n in sums.items() if (what, at) == (5, j)), default=0))
        out[filters[i]] = s
    return out


def _rare_runs(values: DataFrame, counts: DataFrame, made: list, use: list[int], common: dict[int, list[str]], columns: int) -> DataFrame:
    """bucket, column, d, n of rare values and rare grams. Keys with one row of a rare number are not among counts: they are its other rows."""
    runs = counts.where(F.col("what") != keyed.BUCKET)
    numbers = [(i, j) for j, i in enumerate(use) if made[j].kind != "text"]
    if numbers:
        spark = values.sparkSession
        known = spark.createDataFrame([(i, v) for i, _ in numbers for v in common[i]], "i int, f string")
        place = F.create_map(*(F.lit(x) for p in numbers for x in p))
        each = values.where(F.col("f").isNotNull() & F.col("i").isin(*(i for i, _ in numbers))).join(F.broadcast(known), ["i", "f"], "left_anti")  # Options bound how many there are
        each = each.select(place[F.col("i")].cast("int").alias("i"), F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"n{k}").alias("n")) for k in range(columns)))).alias("v"), F.coalesce("b", F.lit(0).cast("long")).alias("b"), "x")
        runs = runs.unionByName(each.select(F.lit(keyed.VALUE).alias("what"), "i", "v.c", "b", "x", F.lit(0).cast("long").alias("d"), "v.n").where("n > 0"))
    w = Window.partitionBy("what", "i", "c", "b", "x").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, more = F.sum("n").over(w), F.sum(F.when(F.col("d") > 0, (F.col("d") - 1) * F.col("n")).otherwise(F.lit(0))).over(w)
    kind = F.when(F.col("what") == keyed.VALUE, F.lit("rest")).otherwise(F.lit("gram rest"))
    reach = runs.select(F.concat_ws(" ", F.col("i").cast("string"), kind).alias("bucket"), F.col("c").cast("string").alias("column"), F.greatest("d", F.lit(1)).alias("c"), F.when(F.col("d") > 0, upto).otherwise(F.col("n") - more).alias("r"))
    return reach_maximum(reach)


def column_cells(table: DataFrame, column: str, options: Options) -> cells.Cells | None:
    """Cells of a filter column: its values if they are few, else base buckets. None for types that tasks are not told of.

    Interval edges are quantiles of values (of least hash, if they are more than options.edge_sample) with their rows.
    """
    if (code := code_columns(table, column)) is None:
        return None
    v = next(x for x in (*code[1:], F.col(column)) if x is not None)
    counts = table.groupBy(column).agg(F.count("*").alias("n")).select(as_text(table, column).alias("f"), v.alias("v"), "n")
    rows = counts.orderBy(F.col("f").isNotNull(), F.xxhash64("f"), "f").limit(options.edge_sample + 1).collect()  # null first
    null, rows = sum(r["n"] for r in rows if r["f"] is None), [r for r in rows if r["f"] is not None][: options.edge_sample]
    kind, complete = table.schema[column].dataType.simpleString(), len(rows) < options.edge_sample
    found = sorted(((r["v"], r["n"], r["f"]) for r in rows if r["v"] == r["v"]), key=lambda r: r[0])
    bins = 2 ** max(0, math.ceil(math.log2(max(1, options.buckets)))) - 1
    at = _quantiles([(x, n) for x, n, _ in found], bins) if kind != "boolean" else []
    edges, ends = [parsed(found[k][2], kind) for k in at], [found[k][0] for k in at]
    few = complete and len(found) == len(rows) <= min(cells.FEW, options.common_values)
    if few:
        number = F.lit(None).cast("int")
        for j, (x, _, _) in enumerate(found):
            number = F.when(v == F.lit(x), j).otherwise(number)
    else:
        number = sum(((v > F.lit(e)).cast("int") for e in ends), F.when(v.isNotNull(), 0))
    out = cells.Cells(kind, number, edges, interval_list(edges) if edges else [], [bisect_left(ends, x) for x, _, _ in found] if few else list(range(len(ends) + 1)), [f for _, _, f in found] if few else None, [], 0)
    held: dict[int | None, int] = {None: null}
    if not complete:
        held |= {r["c"]: r["n"] for r in table.groupBy(number.alias("c")).agg(F.count("*").alias("n")).collect()}
    else:
        for j, (x, n, _) in enumerate(found):
            b = j if few else bisect_left(ends, x)
            held[b] = held.get(b, 0) + n
        if len(found) < len(rows):  # not a number, which is beyond all edges
            held[len(ends)] = held.get(len(ends), 0) + sum(r["n"] for r in rows if r["v"] != r["v"])
    out.rows, out.null = [held.get(j, 0) for j in range(len(out.bases))], null
    return out


def celled_statistics(found: dict[str, Functions], rows: dict[str, int], own: list[cells.Cells], options: Options) -> list[FilterStats]:
    """Of filter columns whose cells are given, from functions and rows by bucket."""
    out = []
    for i, c in enumerate(own):

        def functions_of(bucket: str, i=i) -> Functions:
            n = rows.get(f"{i} {bucket}", 0)
            return {**found.get(f"{i} {bucket}", {}), ROWS: compress([n], [1], options.error, options.strategy, options.mode)} if n else {}

        s = FilterStats(c.kind, functions_of(cells.NOT_NULL), functions_of(cells.NULL) if options.track_nulls else None, singles=c.values is not None)
        s.intervals = [Interval(*interval_ends(name, c.edges), fs) for name, _, _ in c.intervals if (fs := functions_of(f"interval {name}"))]
        if c.values is not None:
            labels, s.groups = _grouped([functions_of(f"value {j}") for j in range(len(c.values))], options)
            s.common = dict(zip((parsed(v, c.kind) for v in c.values), labels, strict=True))
        out.append(s)
    return out


def spread_statistics(rows: DataFrame, join_columns: tuple[str, ...], filters: tuple[str, ...], options: Options) -> list[FilterStats]:
    """Statistics of the join columns given filter columns of any type: counts of (filter column, join column, key, value) go through a shuffle."""
    kinds = [rows.schema[c].dataType.simpleString() for c in filters]
    counts = column_counts(rows, join_columns, filters).persist()
    try:
        values = counts.where((F.col("column") == ROWS) & F.col("f").isNotNull()).select("i", F.col("f").alias("v"), "n")
        common = _top(values, options.common_values, len(filters))
        sample = rows.select(*filters).orderBy(F.xxhash64(*dict.fromkeys((*join_columns, *filters)))).limit(options.edge_sample).select(*(as_text(rows, c).alias(f"f{i}") for i, c in enumerate(filters))).collect()
        bins = 2 ** max(0, math.ceil(math.log2(max(1, options.buckets)))) - 1
        edges: list[list] = []
        for i, kind in enumerate(kinds):
            own = sorted(v for v in (parsed(r[i], kind) for r in sample) if v is not None and v == v)
            edges.append(sorted({own[len(own) * j // (bins + 1)] for j in range(1, bins + 1)}) if own and kind != "boolean" else [])
        top: list[list[str]] = [[] for _ in filters]
        same: list[dict[str, str]] = [{} for _ in filters]
        texts = [i for i, kind in enumerate(kinds) if kind == "string"]
        if options.track_grams and texts:
            each = values.where(F.col("i").isin(*texts)).select("i", F.explode(grams(F.col("v"))).alias("v"), "n").groupBy("i", "v").agg(F.sum("n").alias("n"))
            top = _top(each, options.common_grams, len(filters))
            complete = [i for i in texts if len(common[i]) < options.common_values]
            same = _same_grams(top, common, gram_sets(values, complete), len(filters))
        found = step_functions(conditioned_runs(counts, kinds, common, edges, top, options, same), options)
    finally:
        counts.unpersist()
    made = []
    for i, kind in enumerate(kinds):
        own = {name.split(" ", 1)[1]: fs for name, fs in found.items() if name.split(" ", 1)[0] == str(i)}
        out = FilterStats(kind, own.get("not null", {}), own.get("null", {}) if options.track_nulls else None)
        for name, fs in own.items():
            if name.startswith("interval "):
                out.intervals.append(Interval(*interval_ends(name[9:], edges[i]), fs))
        labels, out.groups = _grouped([own[f"value {k}"] for k in range(len(common[i]))], options)
        out.common = dict(zip((parsed(v, kind) for v in common[i]), labels, strict=True))
        out.rest = own.get("rest", {})
        own |= {f"gram {top[i].index(g)}": own[name] for g, name in same[i].items()}
        if i in texts and options.track_grams:
            labels, out.gram_groups = _grouped([own[f"gram {k}"] for k in range(len(top[i]))], options)
            out.common_grams = dict(zip(top[i], labels, strict=True))
            out.gram_rest = own.get("gram rest", {})
        made.append(out)
    return made


def build(tables: Mapping[str, DataFrame], schema: Schema, options: Options = Options(), only: set[str] | None = None, needs: Mapping[str, Need] | None = None) -> Statistics:  # noqa: B008
    """Statistics of the tables that schema declares (of `only` some of them); filters reach one foreign key far.

    needs: by table, all that will be asked for. Nothing else is built; what is asked for is of all rows. Values and grams
    are grouped by the join columns that are asked for, so bounds may differ from those of whole statistics, as safe.
    """
    made, todo, rows, numbers = {}, [], {}, {}

    def whole(stats: TableStats, c: str, runs: DataFrame) -> None:
        runs = runs.select(F.lit("full").alias("bucket"), F.lit(c).alias("column"), "d", "n")
        stats.full |= step_functions(runs, options, options.error / 4).get("full", {})

    def full(name: str) -> None:
        for c in columns[name]:
            if (name, c) not in known and not any(t[0] is made[name] and t[5] and t[5].column == c for t in todo):
                whole(made[name], c, degree_runs(tables[name], c))

    def conditioned(task) -> None:
        stats, names, rows, join_columns, filters, keys, numbers = task
        if keys:
            keys.counts.persist()  # rows are counted by key once: for all rows, for values, and for degrees
        try:
            if keys and keys.column in join_columns and (next(name for name in made if made[name] is stats), keys.column) not in known:
                whole(stats, keys.column, keys.counts.groupBy(F.col("n").alias("d")).agg(F.count("*").alias("n")))
            for key, found in zip(names, filter_statistics(rows, join_columns, filters, options, keys, numbers), strict=True):
                stats.filters[key] = found
        finally:
            if keys:
                keys.counts.unpersist()

    def sized(name: str) -> None:
        """Rows; where nothing is told of lookups also about how many keys, which steer work alone and cells don't ask for."""
        counted = columns[name] if needs is None or needs[name].lookups is None else ()
        rows[name], *n = tables[name].agg(F.count("*"), *(F.approx_count_distinct(c) for c in counted)).first()
        numbers[name] = dict(zip(counted, n, strict=True)) if counted else None

    def asked(name: str, key: tuple[str, ...]) -> bool:
        return needs is None or key in needs[name].filters

    def may_be_celled(name: str, key: tuple[str, ...]) -> bool:
        if needs is None or needs[name].lookups is None or (key, LIKE) in needs[name].lookups:
            return False
        # tasks that deal many rows by several columns deal them at once
        return len(key) == 1 or columns[name] == (key[0],) or (key[0] in columns[name] and rows[name] <= LARGE)

    def place(name: str, key: tuple[str, ...]) -> tuple[str, str]:
        return (key[1], key[2]) if len(key) > 1 else (name, key[0])

    def celled(name: str, keys: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """Those of the filters that cells will do for."""
        return [k for k in keys if may_be_celled(name, k) and (c := cell.get(place(name, k))) and (c.values is not None or (k, EQUAL) not in needs[name].lookups)]

    def in_cells(task) -> None:
        name, fk, keys = task
        own = [cell[place(name, k)] for k in keys]
        functions: dict[str, Functions] = {}
        held: dict[str, int] = {}
        if fk:
            of_key = made[fk.key_table].full.get(fk.key_column) if fk.key_table in made else None
            unique = of_key is not None and of_key.rows_at(1.0) == 1  # of all rows, and never too low
            source = foreign_key_join(tables[name].select(*columns[name]), fk.column, tables[fk.key_table], fk.key_column, cells.numbered(own))
        else:
            source = tables[name].select(*columns[name], *cells.numbered(own))
        for c in columns[name]:
            alike = cells.reached_keys(tables[name], c, tables[fk.key_table], fk.key_column, own, unique) if fk and c == fk.column else cells.own_keys(source, c, own)
            found, names = cells.runs(alike, own)
            of_all, sums = str(names.index(cells.FULL)), {}
            by_bucket = step_functions(found.select(F.col("bucket").cast("string").alias("bucket"), F.lit(c).alias("column"), "d", "n"), options, {of_all: options.error / 4}, sums)
            whole_of = by_bucket.pop(of_all, {})
            if not fk or c == fk.column:  # other columns are without rows that refer to nothing
                made[name].full |= whole_of
                held |= {names[int(b)]: n for b, n in sums.items()}
            for b, fs in by_bucket.items():
                functions.setdefault(names[int(b)], {}).update(fs)
        if not fk:  # rows without a key too
            for i, c in enumerate(own):
                held |= {f"{i} {b}": sum(c.rows[j] for j in js) for b, js in c.buckets()} | {f"{i} {cells.NULL}": c.null}
        for key, s in zip(keys, celled_statistics(functions, held, own, options), strict=True):
            made[name].filters[key] = s

    for name in schema.tables:
        if (only is None or name in only) and (needs is None or name in needs):
            made[name] = TableStats({})
    columns = {name: tuple(c for c in schema.tables[name].join_columns if needs is None or c in needs[name].columns) for name in made}
    wanted: dict[str, list[tuple[ForeignKey | None, list[tuple[str, ...]]]]] = {}
    for name in made:
        wanted[name] = [(None, [(c,) for c in schema.tables[name].filter_columns if asked(name, (c,))])]
        for fk in schema.keys_from(name):
            if fk.key_table in tables:
                wanted[name].append((fk, [k for c in schema.tables[fk.key_table].filter_columns if asked(name, k := (fk.column, fk.key_table, c))]))
    with ThreadPoolExecutor(options.jobs) as pool:  # jobs of several tables share the executors
        for x in [pool.submit(sized, name) for name in made]:
            x.result()
        places = list(dict.fromkeys(place(name, k) for name in made for _, keys in wanted[name] for k in keys if may_be_celled(name, k)))
        cell = dict(zip(places, pool.map(lambda x: column_cells(tables[x[0]], x[1], options), places), strict=True))
    few, known, order = [], set(), {}
    for name, stats in made.items():
        table = tables[name]
        stats.full = dict.fromkeys((*columns[name], ROWS), ZERO)
        if rows[name]:
            stats.full[ROWS] = compress([rows[name]], [1], options.error / 4, options.strategy, options.mode)
        order[name] = [k for _, keys in wanted[name] for k in keys]
        for fk, keys in wanted[name]:
            if own := celled(name, keys):
                few.append((name, fk, own))
                known |= {(name, c) for c in columns[name] if not fk or c == fk.column}
            keys = [k for k in keys if k not in own]
            if keys and numbers[name] is None:
                numbers[name] = _key_numbers(table, columns[name])
            if keys and not fk:
                names = tuple(c for (c,) in keys)
                todo.append((stats, keys, table.select(*dict.fromkeys((*columns[name], *names))), columns[name], names, None, numbers[name]))
            elif keys:
                reached = [c for *_, c in keys]
                named = [F.col(c).alias(f"reached_{c}") for c in reached]
                joined = foreign_key_join(table.select(*dict.fromkeys((*columns[name], fk.column))), fk.column, tables[fk.key_table], fk.key_column, named)
                by_key = table.where(F.col(fk.column).isNotNull()).groupBy(fk.column).agg(F.count("*").alias("n"), *(F.count(c).alias(f"n{k}") for k, c in enumerate(columns[name])))
                of_keys = Keys(fk.column, foreign_key_join(by_key, fk.column, tables[fk.key_table], fk.key_column, named), by_key)
                todo.append((stats, keys, joined, columns[name], tuple(f"reached_{c}" for c in reached), of_keys, numbers[name]))
    first = [(in_cells, t, rows[t[0]]) for t in few if not t[1]] + [(full, name, 0) for name in made]  # degrees of keys are known then
    then = [(in_cells, t, rows[t[0]]) for t in few if t[1]] + [(conditioned, t, max(rows[name] for name in made if t[0] is made[name])) for t in todo]
    with ThreadPoolExecutor(options.jobs) as pool:
        for work in (first, then):
            small = [pool.submit(f, t) for f, t, n in work if n <= LARGE]
            for f, t, n in work:
                if n > LARGE:
                    f(t)
            for x in small:
                x.result()
    for name, stats in made.items():  # in the order of the schema, whichever was done first
        stats.filters = {k: stats.filters[k] for k in order[name]}
    return Statistics(schema, made, options)


# --- keeping statistics


def save(spark: SparkSession, stats: Statistics, path: str) -> None:
    """As Parquet: a row for each bucket and join column, partitioned by table; one JSON row for the rest."""
    import json

    rows, heads = [], []

    def put(table, key, bucket, fs):
        for c, f in (fs or {}).items():
            rows.append((table, "|".join(key), bucket, c, *f.arrays()))

    def plain(v):
        return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v

    for name, t in stats.tables.items():
        put(name, (), "full", t.full)
        for key, s in t.filters.items():
            put(name, key, "not null", s.not_null)
            put(name, key, "null", s.null)
            put(name, key, "rest", s.rest)
            put(name, key, "gram rest", s.gram_rest)
            for kind, groups in (("group", s.groups), ("gram group", s.gram_groups), ("interval", [i.functions for i in s.intervals])):
                for i, fs in enumerate(groups):
                    put(name, key, f"{kind} {i}", fs)
            heads.append((name, "|".join(key), json.dumps({"kind": s.kind, "null": s.null is not None, "singles": s.singles, "common": [[plain(k), v] for k, v in s.common.items()], "groups": len(s.groups), "gram_groups": len(s.gram_groups), "intervals": [[plain(i.low), plain(i.high)] for i in s.intervals], "grams": s.common_grams})))
    spark.createDataFrame(rows, "table string, filter string, bucket string, column string, edges array<double>, slopes array<double>").repartition("table").write.mode("overwrite").partitionBy("table").parquet(f"{path}/functions")
    spark.createDataFrame(heads, "table string, filter string, head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")


def load(spark: SparkSession, path: str, schema: Schema, options: Options = Options()) -> Statistics:  # noqa: B008
    import json

    by: dict = {}
    for r in spark.read.parquet(f"{path}/functions").collect():
        by.setdefault((r["table"], r["filter"]), {}).setdefault(r["bucket"], {})[r["column"]] = Step(np.array(r["edges"], dtype=float), np.array(r["slopes"], dtype=float))
    tables = {t: TableStats(fs["full"]) for (t, key), fs in by.items() if not key}
    for r in spark.read.parquet(f"{path}/heads").collect():
        h, fs = json.loads(r["head"]), by.get((r["table"], r["filter"]), {})
        s = FilterStats(h["kind"], fs.get("not null", {}), fs.get("null", {}) if h["null"] else None, rest=fs.get("rest", {}), gram_rest=fs.get("gram rest", {}), common_grams=h["grams"], singles=h.get("singles", True))
        s.groups = [fs.get(f"group {i}", {}) for i in range(h["groups"])]
        s.gram_groups = [fs.get(f"gram group {i}", {}) for i in range(h["gram_groups"])]
        value = lambda v, s=s: None if v is None else s.value(v)
        s.common = {value(k): v for k, v in h["common"]}
        s.intervals = [Interval(value(a), value(b), fs.get(f"interval {i}", {})) for i, (a, b) in enumerate(h["intervals"])]
        tables[r["table"]].filters[tuple(r["filter"].split("|"))] = s
    return Statistics(schema, tables, options)


def key_of(fk: ForeignKey, column: str) -> tuple[str, ...]:
    return (fk.column, fk.key_table, column)
