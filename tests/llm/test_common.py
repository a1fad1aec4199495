import os

from rowceil.llm import common


def test_stored_frames_and_release(spark):
    df = common.stored(spark.range(5).toDF("n"), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path) and path.startswith(common.shared_root(spark).removeprefix("file://"))
    common.release(spark)
    assert not os.path.exists(path)


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0bc d ",), (None,), ("",)], "t string")
    from pyspark.sql import functions as F

    assert [r.w for r in df.select(common.words_of(F.col("t")).alias("w")).collect()] == [["a", "b", "c d"], [], []]


def test_release_of_some(spark):
    one, two = common.stored(spark.range(3), "one"), common.stored(spark.range(4), "two")
    path = one.inputFiles()[0].removeprefix("file://")
    common.release(spark, [p for p in common.made_paths(spark) if "/one-" in p])
    assert two.count() == 4 and not os.path.exists(path) and not any("/one-" in p for p in common.made_paths(spark))
    common.release(spark)
