import pytest

from rowceil.model import STAR, ForeignKey, Schema, TableSpec
from rowceil.plans.parser import parse, parse_aggregate, parse_one
from rowceil.plans.query import AnyOf, InQuery, Predicate, Query


def triangle():
    q = Query()
    for t in "RST":
        q.add_alias(t, t.lower())
    return q.add_join("r", "b", "s", "b").add_join("s", "c", "t", "c").add_join("t", "a", "r", "a")


def test_reader_knows_the_grammar():
    q = parse_one(
        "SELECT * FROM title AS t, cast_info ci -- a comment\n WHERE t.id = ci.movie_id AND t.year > 2000 AND ci.note LIKE '%(voice)%' AND ci.role IN (1, 2)"
        " AND ci.kind IN ['a', 'b'] AND t.x IS NULL AND t.y IS NOT NULL AND t.title NOT LIKE 'It''s%' AND t.z ne -1.5 AND t.w BETWEEN 1 AND 2 AND t.v NOT IN (3);"
    )
    assert q.tables == {"t": "title", "ci": "cast_info"} and len(q.joins) == 1
    assert [(p.op, p.value) for p in q.predicates] == [
        (">", 2000), ("LIKE", "%(voice)%"), ("IN", (1, 2)), ("IN", ("a", "b")), ("IS NULL", None), ("IS NOT NULL", None), ("NOT LIKE", "It's%"), ("!=", -1.5), ("BETWEEN", (1, 2)), ("NOT IN", (3,)),
    ]
    assert parse_one(q.sql()) == q
    assert len(parse("SELECT * FROM a; # note\nSELECT COUNT(*) FROM b AS x WHERE x.c = 1;")) == 2
    assert parse_one("SELECT * FROM a WHERE a.x = 1 OR a.x = 2").any_of == [AnyOf("a", (Predicate("a", "x", "=", 1), Predicate("a", "x", "=", 2)))]
    sub = parse_one("SELECT * FROM a WHERE a.x IN (SELECT b.y FROM b WHERE b.z < 3)").in_queries[0]
    assert isinstance(sub, InQuery) and sub.out == ("b", "y")
    assert parse_one("SELECT * FROM a AS x JOIN b AS y ON x.i = y.i WHERE y.k >= '2010-01-01'::timestamp").predicates[0].value == "2010-01-01"


@pytest.mark.parametrize("bad", ["SELECT", "SELECT * FROM a WHERE a.x <", "SELECT * FROM a WHERE b.x = 1", "SELECT * FROM a, b WHERE a.x < b.x", "SELECT * FROM a WHERE (a.x = 1 OR a.y = 2 AND a.z = 3)", "SELECT * FROM a ?"])
def test_reader_refuses(bad):
    with pytest.raises(ValueError):
        parse_one(bad)


def test_aggregate_queries():
    a = parse_aggregate("SELECT g, SUM(x * y) - SUM(z) FROM t WHERE t.k = 1 GROUP BY g ORDER BY g WHAT IF t.k = 1 AND t.z > 2 INCREASE BY 10% WHAT IF t.z < 0 DECREASE BY 5%")
    assert [(t.kind, t.columns, t.sign) for t in a.terms] == [("SUM", (("t", "x"), ("t", "y")), 1), ("SUM", (("t", "z"),), -1)]
    assert a.group_by == [("t", "g")] and [(len(p), c) for p, c in a.what_if] == [(2, 0.1), (1, -0.05)]
    with pytest.raises(ValueError):
        parse_aggregate("SELECT SUM(x) + AVG(y) FROM t")


def test_classes_closure_and_cycles():
    q = parse_one("SELECT * FROM a, b, c WHERE a.x = b.x AND b.x = c.x")
    assert q.classes() == [[("a", "x"), ("b", "x"), ("c", "x")]] and len(q.closed().joins) == 3 and not q.closed().cyclic() and q.closed().cycles() == []
    t = triangle()
    assert t.cyclic() and len(t.cycles()) == 1 and len(list(t.spanning_trees())) == 3


def test_subsets_walks_and_parts():
    q = parse_one("SELECT * FROM a, b, c, d WHERE a.x = b.x AND b.y = c.y AND d.z = 1")
    assert q.parts() == [["a", "b", "c"], ["d"]] and q.generations("a") == {"a": 0, "b": 1, "c": 2}
    assert q.connected_subsets(2) == [("a", "b"), ("b", "c"), ("a", "b", "c")]
    s = q.restricted(["a", "b"])
    assert s.connected_subsets(2) == [("a", "b")] and "a.x = b.x" in s.sql() and q.copy() == q and "d.z" in q.describe()
    assert [x[2] for x in q.walk("c")] == ["b", "a"]


def test_key_tables():
    q = parse_one("SELECT * FROM supplier AS s, customer AS c WHERE s.s_nationkey = c.c_nationkey")
    w = q.with_key_tables(STAR)
    assert "nation" in w.tables.values() and len(w.joins) == 2
    back = parse_one("SELECT * FROM lineitem AS l, part AS p WHERE l.l_partkey = p.p_partkey").without_key_tables(STAR)
    assert list(back.tables.values()) == ["lineitem"] and back.predicates == [Predicate("l", "l_partkey", "IS NOT NULL")]


def test_schema_checks():
    a, b = TableSpec("a", ("x", "y")), TableSpec("b", ("x", "y"))
    with pytest.raises(ValueError, match="cycle"):
        Schema.of([a, b], [ForeignKey("a", "x", "b", "x"), ForeignKey("b", "y", "a", "y")])
    with pytest.raises(ValueError, match="undeclared"):
        Schema.of([a], [ForeignKey("a", "x", "b", "x")])
    with pytest.raises(ValueError):
        Query().add_alias("a").add_predicate("z", "x", "=", 1)
    with pytest.raises(ValueError):
        Predicate("a", "x", "~", 1)
