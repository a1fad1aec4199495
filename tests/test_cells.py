"""Statistics of filter columns whose values fall into few cells."""

from collections import Counter

import pytest

from rowceil import queries
from rowceil.functions.step import Step
from rowceil.model import ForeignKey, Schema, TableSpec
from rowceil.operators import exact, statistics
from rowceil.plans import bound
from rowceil.plans.parser import parse_one

CLOSE = statistics.Options(error=1e-9, buckets=4, common_values=50, groups=50, edge_sample=30)


def step(keys) -> list[float]:
    """Rows of the first 0, 1, 2, ... most frequent keys."""
    exactly = Step.of_degrees(list(Counter(keys).values()))
    return [round(float(x), 6) for x in exactly.rows_at(range(int(exactly.keys) + 2))]


def same(f, keys) -> bool:
    return [round(float(x), 6) for x in f.rows_at(range(len(set(keys)) + 2))] == step(keys)


@pytest.fixture(scope="module")
def star(spark):
    """Facts with null keys and keys that refer to nothing; key rows with nulls, no numbers, and a key that occurs twice."""
    facts = [(None if i % 11 == 0 else i * i % 23, i % 7) for i in range(900)]
    keys = [(k, None if k % 9 == 0 else float("nan") if k % 8 == 0 else float(k * 7 % 20), None if k == 3 else "ab"[k % 2]) for k in range(20)] + [(4, 1.0, "a")]
    schema = Schema.of([TableSpec("d", ("id",), ("x", "v")), TableSpec("f", ("k",), ("m",))], [ForeignKey("f", "k", "d", "id")])
    t = {"f": spark.createDataFrame(facts, "k long, m long"), "d": spark.createDataFrame(keys, "id long, x double, v string")}
    return t, facts, keys, schema


def above(x: float, edge: float) -> bool:
    return x != x or x > edge


@pytest.mark.parametrize("sample", (5, 30))
def test_degrees_in_cells_are_exact(star, sample):
    t, facts, keys, schema = star
    options = statistics.Options(**{**CLOSE.__dict__, "edge_sample": sample})
    reached = [("k", "d", "x"), ("k", "d", "v")]
    need = {"d": statistics.Need(frozenset(("id",)), frozenset({("x",), ("v",)}), frozenset({(("v",), statistics.EQUAL)})), "f": statistics.Need(frozenset(("k",)), frozenset(reached), frozenset({(reached[1], statistics.EQUAL)}))}
    made = statistics.build(t, schema, options, needs=need).tables
    assert same(made["f"].full["k"], [k for k, _ in facts if k is not None]) and made["f"].full[statistics.ROWS].total == 900
    assert same(made["d"].full["id"], [k for k, *_ in keys])
    joined = [(k, x, v) for k, _ in facts for i, x, v in keys if k == i]
    for s, rows, c in ((made["f"].filters[reached[0]], joined, "k"), (made["d"].filters["x",], keys, "id")):
        assert s.intervals and not s.singles and not s.common
        for i in s.intervals:
            own = [k for k, x, _ in rows if x is not None and (i.low is None or above(x, i.low)) and (i.high is None or not above(x, i.high))]
            assert same(i.functions[c], own) and i.functions[statistics.ROWS].total == len(own)
        assert same(s.not_null[c], [k for k, x, _ in rows if x is not None]) and same(s.null[c], [k for k, x, _ in rows if x is None])
        assert s.equal(3.0)[c].total >= sum(x == 3.0 for _, x, _ in rows)  # no single values are known of
    for s, rows, c in ((made["f"].filters[reached[1]], joined, "k"), (made["d"].filters["v",], keys, "id")):
        if not s.singles:  # more values than the sample holds
            continue
        for v in "ab":
            assert same(s.equal(v)[c], [k for k, _, w in rows if w == v])
        assert same(s.null[c], [k for k, _, w in rows if w is None]) and not any(f.total for f in s.equal("c").values())


def test_what_single_values_need_is_not_taken_from_ranges():
    ranges, singles = (statistics.Need(frozenset("k"), frozenset({("x",)}), x) for x in (frozenset(), frozenset({(("x",), statistics.EQUAL)})))
    assert singles.covers(ranges) and not ranges.covers(singles) and not singles.covers(statistics.Need(frozenset("k"), frozenset({("x",)})))


@pytest.mark.parametrize("name", ["disjunction", "snowflake"])
def test_planned_joins_need_no_dealt_rows(spark, sf_dir, monkeypatch, name):
    """All that these plans look up is in few cells."""
    monkeypatch.setattr(queries, "_built", {})

    def dealt(*_):
        raise AssertionError("rows are dealt over all filter values")

    monkeypatch.setattr(statistics.keyed, "dealt", dealt)
    q, t = parse_one(queries.JOINS[name]), queries.tables(spark, sf_dir)
    n = exact.count(t, q)
    assert queries.MADE[f"planned_join_{name}"](spark, sf_dir).first()["n"] == n <= bound.bound(queries.core_statistics(spark, sf_dir, [q]), q) * (1 + 1e-9)


@pytest.mark.parametrize("twice", (False, True))
def test_cells_given_several_columns_and_unique_keys(spark, monkeypatch, twice):
    facts = [(None if i % 13 == 0 else i * i % 17, i % 5) for i in range(400)]
    keys = [(k, "abc"[k % 3] if k % 5 else None) for k in range(12)] + [(2, "a")] * twice
    schema = Schema.of([TableSpec("d", ("id",), ("v",)), TableSpec("f", ("k", "m"))], [ForeignKey("f", "k", "d", "id")])
    t = {"f": spark.createDataFrame(facts, "k long, m long"), "d": spark.createDataFrame(keys, "id long, v string")}
    key, seen, reached = ("k", "d", "v"), [], statistics.cells.reached_keys
    monkeypatch.setattr(statistics.cells, "reached_keys", lambda *a: seen.append(a[-1]) or reached(*a))
    need = {"d": statistics.Need(frozenset(("id",)), frozenset(), frozenset()), "f": statistics.Need(frozenset(("k", "m")), frozenset({key}), frozenset({(key, statistics.EQUAL)}))}
    made = statistics.build(t, schema, CLOSE, needs=need).tables["f"]
    assert seen == [not twice]
    assert same(made.full["k"], [k for k, _ in facts if k is not None]) and same(made.full["m"], [m for _, m in facts])
    joined = [(k, m, v) for k, m in facts for i, v in keys if k == i]
    for v in "abc":
        own = [(k, m) for k, m, w in joined if w == v]
        f = made.filters[key].equal(v)
        assert same(f["k"], [k for k, _ in own]) and same(f["m"], [m for _, m in own]) and f[statistics.ROWS].total == len(own)
    assert same(made.filters[key].null["m"], [m for _, m, w in joined if w is None])
