"""Other estimates of result sizes, and how far estimates are off."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_sample
from ..plans.query import Query
from .exact import alias_rows, count, joined, matched


def optimizer_estimate(df: DataFrame) -> int | None:
    """Rows that Spark's optimizer expects from the statistics of saved tables; None where it has no row count."""
    conf, name = df.sparkSession.conf, "spark.sql.cbo.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        rows = df.select("*")._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return int(str(rows.get())) if rows.isDefined() else None
    finally:
        conf.set(name, before)


def analyze(spark, table: str, columns: Sequence[str]) -> None:
    """Column statistics for Spark's optimizer, of a saved table."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")


def count_within(tables: Mapping[str, DataFrame], q: Query, seconds: float, otherwise: float) -> tuple[float, bool]:
    """The exact size, or `otherwise` (say, a bound) if counting takes too long; and whether it is exact."""
    spark = next(iter(tables.values())).sparkSession
    tag = f"count-{id(q)}"
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return float(count(tables, q)), True
    except Exception:
        if timer.is_alive():
            raise
        return otherwise, False
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def subquery_sizes(tables: Mapping[str, DataFrame], q: Query, seconds: float, bound_of: Callable[[Query], float]) -> list[tuple[str, float, bool]]:
    """For every connected set of two or more aliases: their names, the exact size, or a bound where counting takes too long, and whether it is exact."""
    return [(",".join(sorted(sub.tables)), *count_within(tables, sub, seconds, bound_of(sub))) for sub in q.subqueries()]


def sampled_estimate(tables: Mapping[str, DataFrame], q: Query, share: float, column: Mapping[str, str], full_size: float) -> float:
    """Selectivity of each alias's predicates on a hash sample (of the named column) times the size of the join without predicates."""
    out = full_size
    for a, t in q.tables.items():
        if any(p.alias == a for p in (*q.predicates, *q.any_of, *q.in_queries)):
            sample = {**tables, t: tables[t].where(hash_sample(F.col(column[t]), share))}
            n = sample[t].count()
            out *= (alias_rows(sample, q, a).count() / n) if n else 1.0
    return out


def correlated_samples(tables: Mapping[str, DataFrame], q: Query, root: str, column: str, share: float) -> dict[str, DataFrame]:
    """A hash sample of root's rows, and of every other alias the rows that join with the sample on the way."""
    out = {root: tables[q.tables[root]].where(hash_sample(F.col(column), share))}
    for a, c, b, cb in q.walk(root):
        out[b] = matched(tables[q.tables[b]], cb, out[a], c)
    return out


def join_sample(tables: Mapping[str, DataFrame], q: Query, root: str, column: str, share: float, rows: int, out: Sequence[tuple[str, str]], seed: int = 1) -> tuple[DataFrame, int]:
    """At most `rows` rows of the join from a hash sample of root, those of least seeded hash; and the sample's join size."""
    sampled = {**tables}
    every = Query({a: f"{a}" for a in q.tables}, list(q.joins))
    for a, t in q.tables.items():
        sampled[a] = tables[t]
    sampled[root] = tables[q.tables[root]].where(hash_sample(F.col(column), share))
    df = joined(sampled, every, out)
    n = df.count()
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(rows), n


def full_join_estimate(fk_mean: Sequence[tuple[float, float]], root_rows: float) -> float:
    """Size of a join along foreign keys from mean fan-outs: root rows times (mean, plus the share of rows without partner)."""
    out = root_rows
    for mean, without in fk_mean:
        out *= mean + without
    return out


def q_errors(results: DataFrame) -> DataFrame:
    """results: method, estimate, truth. method and the 5th, 50th and 95th percentile of max(estimate / truth, truth / estimate), both at least 1."""
    e, t = F.greatest(F.col("estimate").cast("double"), F.lit(1.0)), F.greatest(F.col("truth").cast("double"), F.lit(1.0))
    rated = results.select("method", F.greatest(e / t, t / e).alias("q"))
    return rated.groupBy("method").agg(*(F.round(F.percentile("q", F.lit(p)), 6).alias(f"q{int(100 * p):02d}") for p in (0.05, 0.5, 0.95)))


def runtime_summary(results: DataFrame) -> DataFrame:
    """results: method, seconds. method, runs, total, mean, and share of the total of the slowest method."""
    sums = results.groupBy("method").agg(F.count("*").alias("runs"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))
    most = sums.agg(F.max("total").alias("_most"))  # one row
    return sums.join(F.broadcast(most)).withColumn("share", F.col("total") / F.col("_most")).drop("_most")


def runtime_ranks(results: DataFrame) -> DataFrame:
    """results: query, method, seconds. Each with its rank among the query's methods, the fastest first; ties by method."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("seconds", "method")))


def violations(results: DataFrame) -> DataFrame:
    """Results whose bound is below the truth; there must be none."""
    return results.where(F.col("estimate") * (1 + 1e-9) < F.col("truth"))
