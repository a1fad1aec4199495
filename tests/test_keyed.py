import numpy as np
from pyspark.sql import functions as F

from rowceil.model import ForeignKey, Schema, TableSpec
from rowceil.operators import keyed, statistics
from rowceil.operators.exact import foreign_key_join

FEW = statistics.Options(buckets=8, common_values=6, groups=30, common_grams=8)
FILTERS = ("text", "x", "i", "day", "at", "ntz", "yes")


def rows_of(spark, n=3000):
    return spark.range(n).selectExpr(
        "if(id % 2 = 0, 7L, if(id % 11 = 0, null, id % 97)) AS k", "concat('k', id % 13) AS s",
        "if(id % 9 = 0, null, concat('word ', id % 23, substr('abcdef', cast(id % 4 as int) + 1, 2))) AS text",
        "CASE WHEN id % 50 = 0 THEN double('NaN') WHEN id % 51 = 0 THEN -0.0D ELSE (id * 7 % 40) / 100D - 0.1D END AS x",
        "cast(id % 31 as int) AS i", "date_add(date '1999-12-25', cast(id % 19 as int)) AS day", "timestamp_seconds(id % 37 * 3600) AS at",
        "cast(timestamp_seconds(id % 29 * 1800) AS timestamp_ntz) AS ntz", "if(id % 10 = 0, null, id % 3 = 0) AS yes",
    )


def plain(fs):
    return {c: tuple(np.round(a, 9).tolist() for a in f.arrays()) for c, f in (fs or {}).items()}


def as_plain(s):
    text = lambda v: repr(v)  # noqa: E731  NaN is not equal to itself
    return (
        s.kind, plain(s.not_null), plain(s.null), plain(s.rest), plain(s.gram_rest), {text(v): plain(s.groups[g]) for v, g in s.common.items()},
        {g: plain(s.gram_groups[k]) for g, k in (s.common_grams or {}).items()}, sorted((text(i.low), text(i.high), sorted(plain(i.functions).items())) for i in s.intervals),
    )


def test_dealt_rows_give_the_statistics_of_spread_ones(spark, monkeypatch):
    monkeypatch.setattr(keyed, "PART_ROWS", 200)
    monkeypatch.setattr(keyed, "SLICE", 5)
    rows = rows_of(spark).cache()
    for one, other in zip(statistics.filter_statistics(rows, ("k", "s"), FILTERS, FEW), statistics.spread_statistics(rows, ("k", "s"), FILTERS, FEW), strict=True):
        assert as_plain(one) == as_plain(other)


def test_a_key_table_tells_filters_by_key(spark):
    facts, keys = rows_of(spark).select("k", "s").cache(), rows_of(spark, 90).select(F.monotonically_increasing_id().alias("id"), *FILTERS).withColumn("id", F.row_number().over(statistics.Window.orderBy("id"))).cache()
    schema = Schema.of([TableSpec("f", ("k", "s")), TableSpec("d", ("id",), FILTERS)], [ForeignKey("f", "k", "d", "id")])
    made = statistics.build({"f": facts, "d": keys}, schema, FEW, {"f"}).tables["f"]
    joined = foreign_key_join(facts, "k", keys, "id", [F.col(c) for c in FILTERS])
    for c, other in zip(FILTERS, statistics.spread_statistics(joined, ("k", "s"), FILTERS, FEW), strict=True):
        assert as_plain(made.filters["k", "d", c]) == as_plain(other)


def test_texts_of_many_values_are_spread(spark, monkeypatch):
    rows = rows_of(spark).cache()
    whole = statistics.filter_statistics(rows, ("k",), ("text", "x"), FEW)
    monkeypatch.setattr(statistics, "DICTIONARY", 3)
    assert [as_plain(s) for s in statistics.filter_statistics(rows, ("k",), ("text", "x"), FEW)] == [as_plain(s) for s in whole]
