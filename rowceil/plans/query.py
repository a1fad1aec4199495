"""Conjunctive queries of equi-joins: aliases, joins, predicates, and the graph they make."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "LIKE", "NOT LIKE", "IN", "NOT IN", "BETWEEN", "IS NULL", "IS NOT NULL")


def literal(v: Any) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Predicate:
    """alias.column op value; value is a tuple for IN, NOT IN and BETWEEN, None for the tests of NULL."""

    alias: str
    column: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")

    def sql(self) -> str:
        left = f"{self.alias}.{self.column}"
        if self.op in ("IS NULL", "IS NOT NULL"):
            return f"{left} {self.op}"
        if self.op in ("IN", "NOT IN"):
            return f"{left} {self.op} ({', '.join(map(literal, self.value))})"
        if self.op == "BETWEEN":
            return f"{left} BETWEEN {literal(self.value[0])} AND {literal(self.value[1])}"
        return f"{left} {self.op} {literal(self.value)}"


@dataclass(frozen=True)
class AnyOf:
    """A disjunction of predicates on one alias."""

    alias: str
    parts: tuple[Predicate, ...]

    def sql(self) -> str:
        return "(" + " OR ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class InQuery:
    """alias.column IN (a query with one column)."""

    alias: str
    column: str
    query: Query
    out: tuple[str, str]

    def sql(self) -> str:
        return f"{self.alias}.{self.column} IN ({self.query.sql(select=f'{self.out[0]}.{self.out[1]}')})"


@dataclass(frozen=True, order=True)
class Join:
    """Two columns that must be equal; the sides are put in order."""

    left: tuple[str, str]
    right: tuple[str, str]

    @classmethod
    def of(cls, a: str, a_column: str, b: str, b_column: str) -> Join:
        x, y = sorted(((a, a_column), (b, b_column)))
        return cls(x, y)

    @property
    def aliases(self) -> frozenset[str]:
        return frozenset((self.left[0], self.right[0]))

    def side(self, alias: str) -> tuple[str, str]:
        return self.left if self.left[0] == alias else self.right

    def sql(self) -> str:
        return f"{self.left[0]}.{self.left[1]} = {self.right[0]}.{self.right[1]}"


@dataclass
class Query:
    tables: dict[str, str] = field(default_factory=dict)  # alias: table
    joins: list[Join] = field(default_factory=list)
    predicates: list[Predicate] = field(default_factory=list)
    any_of: list[AnyOf] = field(default_factory=list)
    in_queries: list[InQuery] = field(default_factory=list)
    columns: tuple[str, ...] = ("*",)

    def add_alias(self, table: str, alias: str | None = None) -> Query:
        alias = alias or table
        if self.tables.get(alias, table) != table:
            raise ValueError(f"alias {alias} stands for two tables")
        self.tables[alias] = table
        return self

    def add_join(self, a: str, a_column: str, b: str, b_column: str) -> Query:
        for x in (a, b):
            if x not in self.tables:
                raise ValueError(f"unknown alias {x}")
        if (a, a_column) != (b, b_column) and (j := Join.of(a, a_column, b, b_column)) not in self.joins:
            self.joins.append(j)
        return self

    def add_predicate(self, alias: str, column: str, op: str, value: Any = None) -> Query:
        if alias not in self.tables:
            raise ValueError(f"unknown alias {alias}")
        self.predicates.append(Predicate(alias, column, op, value))
        return self

    def copy(self) -> Query:
        return replace(self, tables=dict(self.tables), joins=list(self.joins), predicates=list(self.predicates), any_of=list(self.any_of), in_queries=list(self.in_queries))

    # --- structure

    def classes(self) -> list[list[tuple[str, str]]]:
        """Columns that joins make equal, as sorted lists."""
        up: dict[tuple[str, str], tuple[str, str]] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for j in self.joins:
            a, b = sorted((root(j.left), root(j.right)))
            up[b] = a
        out: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for x in sorted(up):
            out.setdefault(root(x), []).append(x)
        return [out[k] for k in sorted(out)]

    def closed(self) -> Query:
        """With every implied join between different aliases."""
        q = self.copy()
        for c in self.classes():
            for a, b in itertools.combinations(c, 2):
                if a[0] != b[0]:
                    q.add_join(*a, *b)
        q.joins.sort()
        return q

    def neighbours(self, alias: str) -> list[tuple[str, str, str]]:
        """(column, other alias, its column) of the joins of an alias, in order."""
        out = []
        for j in sorted(self.joins):
            if alias in j.aliases and len(j.aliases) == 2:
                mine = j.side(alias)
                other = j.right if mine == j.left else j.left
                out.append((mine[1], *other))
        return out

    def parts(self) -> list[list[str]]:
        """The aliases of each connected part, sorted."""
        left, out = set(self.tables), []
        while left:
            todo, got = [min(left)], set()
            while todo:
                a = todo.pop()
                if a not in got:
                    got.add(a)
                    todo += [o for _, o, _ in self.neighbours(a)]
            left -= got
            out.append(sorted(got))
        return out

    def walk(self, start: str) -> Iterator[tuple[str, str, str, str]]:
        """Breadth first: (alias, column, new alias, its column) of each alias after the start."""
        seen, todo = {start}, deque([start])
        while todo:
            a = todo.popleft()
            for column, other, other_column in self.neighbours(a):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
                    yield a, column, other, other_column

    def generations(self, root: str) -> dict[str, int]:
        depth = {root: 0}
        for a, _, b, _ in self.walk(root):
            depth[b] = depth[a] + 1
        return depth

    def cyclic(self) -> bool:
        """Whether a spanning tree over aliases leaves out a condition that its equalities do not imply."""
        return any(not self._implies(t) for t in self.spanning_trees(1))

    def _implies(self, tree: list[Join]) -> bool:
        classes = replace(self, joins=tree).classes()
        where = {x: i for i, c in enumerate(classes) for x in c}
        return all(j.left in where and where[j.left] == where.get(j.right) for j in self.joins)

    def cycles(self) -> list[Join]:
        """Joins beyond one spanning tree that the tree does not imply."""
        tree = next(self.spanning_trees(1))
        where = {x: i for i, c in enumerate(replace(self, joins=tree).classes()) for x in c}
        return [j for j in sorted(self.joins) if where.get(j.left, -1) != where.get(j.right, -2)]

    def spanning_trees(self, most: int = 64) -> Iterator[list[Join]]:
        """Spanning forests of the closed query (one join for each two aliases), at most so many, in a fixed order."""
        joins = sorted(j for j in self.closed().joins if len(j.aliases) == 2)
        need, found = len(self.tables) - len(self.parts()), 0

        def grow(i: int, chosen: list[Join], group: dict[str, str]) -> Iterator[list[Join]]:
            if len(chosen) == need:
                yield chosen
                return
            for k in range(i, len(joins)):
                a, b = (group[x] for x in sorted(joins[k].aliases))
                if a != b:
                    yield from grow(k + 1, [*chosen, joins[k]], {x: a if g == b else g for x, g in group.items()})

        for tree in grow(0, [], {a: a for a in self.tables}):
            yield tree
            found += 1
            if found >= most:
                return

    # --- derived queries

    def restricted(self, aliases) -> Query:
        """The query over some aliases: their joins and predicates, with the joins implied among them."""
        keep = set(aliases)
        q = self.closed()
        return Query(
            {a: t for a, t in self.tables.items() if a in keep},
            [j for j in q.joins if j.aliases <= keep],
            [p for p in self.predicates if p.alias in keep],
            [p for p in self.any_of if p.alias in keep],
            [p for p in self.in_queries if p.alias in keep],
        )

    def connected_subsets(self, least: int = 2) -> list[tuple[str, ...]]:
        """Every set of aliases that joins connect, of `least` or more, by size and name."""
        names = sorted(self.tables)
        at = {a: i for i, a in enumerate(names)}
        near = [0] * len(names)
        for j in self.closed().joins:
            if len(j.aliases) == 2:
                a, b = (at[x] for x in j.aliases)
                near[a] |= 1 << b
                near[b] |= 1 << a
        found, level = set(), {1 << i for i in range(len(names))}
        while level:
            found |= level
            grown = set()
            for s in level:
                edge = 0
                for i in range(len(names)):
                    if s >> i & 1:
                        edge |= near[i]
                edge &= ~s
                grown |= {s | 1 << i for i in range(len(names)) if edge >> i & 1}
            level = grown - found
        sets = [tuple(names[i] for i in range(len(names)) if s >> i & 1) for s in found]
        return sorted((s for s in sets if len(s) >= least), key=lambda s: (len(s), s))

    def subqueries(self) -> list[Query]:
        return [self.restricted(s) for s in self.connected_subsets(2)]

    def with_key_tables(self, schema) -> Query:
        """Where two foreign keys to one key are joined with each other, the key's table is put between them."""
        q = self.copy()
        refs = {(fk.table, fk.column): (fk.key_table, fk.key_column) for fk in schema.foreign_keys}
        for c in self.classes():
            targets = {refs.get((self.tables[a], col)) for a, col in c}
            if len(c) > 1 and len(targets) == 1 and None not in targets:
                (table, column), = targets
                alias = f"{table}_key_{c[0][0]}"
                q.joins = [j for j in q.joins if not (j.left in c and j.right in c)]
                q.add_alias(table, alias)
                for a, col in c:
                    q.add_join(alias, column, a, col)
        return q

    def without_key_tables(self, schema) -> Query:
        """Drops a key table that has no predicate and one foreign key joined to it (with no other use); nulls excluded instead."""
        q = self.copy()
        for alias, table in list(self.tables.items()):
            if len(q.tables) < 2 or any(p.alias == alias for p in (*q.predicates, *q.any_of, *q.in_queries)):
                continue
            near = q.neighbours(alias)
            if len(near) == 1:
                column, other, other_column = near[0]
                if any((fk.table, fk.column, fk.key_table, fk.key_column) == (q.tables[other], other_column, table, column) for fk in schema.foreign_keys):
                    q.joins = [j for j in q.joins if alias not in j.aliases]
                    del q.tables[alias]
                    q.add_predicate(other, other_column, "IS NOT NULL")
        return q

    # --- text

    def conditions(self) -> list[str]:
        return [j.sql() for j in self.joins] + [p.sql() for p in (*self.predicates, *self.any_of, *self.in_queries)]

    def sql(self, select: str = "*") -> str:
        out = f"SELECT {select} FROM " + ", ".join(f"{t} AS {a}" for a, t in self.tables.items())
        return out + (" WHERE " + " AND ".join(c) if (c := self.conditions()) else "")

    def count_sql(self) -> str:
        return self.sql("COUNT(*)")

    def describe(self) -> str:
        lines = [f"{a}: {t}" for a, t in sorted(self.tables.items())]
        lines += [f"  {j.sql()}" for j in sorted(self.joins)] + [f"  {p.sql()}" for p in (*self.predicates, *self.any_of, *self.in_queries)]
        return "\n".join(lines)
