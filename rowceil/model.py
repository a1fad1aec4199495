"""What a caller declares about tables: join columns, filter columns, foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    name: str
    join_columns: tuple[str, ...] = ()
    filter_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    """table.column refers to key_table.key_column, which is unique."""

    table: str
    column: str
    key_table: str
    key_column: str


@dataclass
class Schema:
    tables: dict[str, TableSpec] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    @classmethod
    def of(cls, tables: list[TableSpec], foreign_keys: list[ForeignKey] = ()) -> Schema:
        made = cls({t.name: t for t in tables}, list(foreign_keys))
        made.validate()
        return made

    def validate(self) -> None:
        for fk in self.foreign_keys:
            for name, column in ((fk.table, fk.column), (fk.key_table, fk.key_column)):
                if name not in self.tables:
                    raise ValueError(f"foreign key names an undeclared table: {name}")
                if column not in self.tables[name].join_columns:
                    raise ValueError(f"foreign key names an undeclared join column: {name}.{column}")
        state: dict[str, int] = {}

        def visit(t: str) -> None:
            if state.get(t) == 1:
                raise ValueError(f"foreign keys form a cycle through {t}")
            if t not in state:
                state[t] = 1
                for fk in self.foreign_keys:
                    if fk.table == t:
                        visit(fk.key_table)
                state[t] = 2

        for t in self.tables:
            visit(t)

    def keys_from(self, table: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys if fk.table == table]


#: The driver's tables: join and filter columns and keys of the star schema.
STAR = Schema.of(
    [
        TableSpec("region", ("r_regionkey",), ("r_name",)),
        TableSpec("nation", ("n_nationkey", "n_regionkey"), ("n_name",)),
        TableSpec("supplier", ("s_suppkey", "s_nationkey"), ("s_name", "s_acctbal")),
        TableSpec("customer", ("c_custkey", "c_nationkey"), ("c_mktsegment", "c_acctbal", "c_name")),
        TableSpec("part", ("p_partkey",), ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        TableSpec("orders", ("o_orderkey", "o_custkey"), ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        TableSpec("lineitem", ("l_orderkey", "l_partkey", "l_suppkey"), ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice")),
        TableSpec("events", ("user_id",), ("ts", "event_type", "value")),
    ],
    [
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ],
)
