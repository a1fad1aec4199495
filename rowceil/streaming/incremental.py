"""Keeping degree statistics up to date from a stream.

Counts by key are additive: each micro-batch is reduced to counts for its keys and appended under its batch number, a
batch that comes again after a failure overwrites itself, and degrees are sums over batches. Old batches can be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import pair_counts


def _add_batch(path: str, columns: tuple[str, ...]):
    def add(batch: DataFrame, number: int) -> None:
        pair_counts(batch, columns, None).select("column", "key", "n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def maintain(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str):
    """A started streaming query that keeps counts of the join columns of `stream` under path."""
    return stream.writeStream.foreachBatch(_add_batch(path, tuple(columns))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """column, key, n over all batches."""
    return spark.read.parquet(path).groupBy("column", "key").agg(F.sum("n").alias("n"))


def current_runs(spark: SparkSession, path: str, column: str) -> DataFrame:
    """d, n: the degree runs of one column so far."""
    return current_counts(spark, path).where(F.col("column") == column).groupBy(F.col("n").alias("d")).agg(F.count("*").alias("n"))


def merged(spark: SparkSession, path: str, into: str) -> None:
    """All batches as one, elsewhere."""
    current_counts(spark, path).write.mode("overwrite").parquet(f"{into}/batch=-1")


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of key in tumbling windows, of rows at most `late` behind."""
    w = F.window(F.col(ts), window)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
