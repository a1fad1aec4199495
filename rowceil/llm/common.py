"""Storage shared by driver and executors, and small helpers that all operators of this subpackage use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}

#: What separates words in the text contracts: space and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests on one machine) a temporary one is made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        found = tempfile.mkdtemp(prefix="rowceil-")
        _own[spark.sparkContext.applicationId] = found
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made_paths(spark: SparkSession) -> list[str]:
    """What this application has stored in the shared folder and not released, oldest first."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes what this application has stored in the shared folder (or those of its paths); frames that read it can't be used afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = _made.get(spark.sparkContext.applicationId, [])
    for path in [x for x in held if paths is None or x in paths]:
        held.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Lets Spark delete the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends in files that outlive any executor, so the shuffles behind them can go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", "1").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that are sent to all tasks; of a larger one, each goes to SALTS parts of its key.
BROADCAST_ROWS, SALTS = 100_000, 16


def looked_up(rows: DataFrame, narrow: DataFrame, on: list[str], salt, how: str = "inner") -> DataFrame:
    """rows joined with a narrow table that has each key once, where a key may have very many of the rows. salt: a long that differs among them."""
    if narrow.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(narrow), on, how)
    every = narrow.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt_"))
    return rows.withColumn("salt_", F.pmod(salt, F.lit(SALTS)).cast("int")).join(every, [*on, "salt_"], how).drop("salt_")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text) -> F.Column:
    """The words of a text by the contracts' blanks; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")
