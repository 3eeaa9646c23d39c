"""Aggregate queries as objects, so that their parts can be asked for and their tables replaced by samples."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Join:
    """An inner join of the fact table with a dimension on fact column = dimension column."""

    table: str
    left: str
    right: str


@dataclass(frozen=True)
class Query:
    """agg is avg, sum or count of value, a SQL expression, or ratio: the sum of value by the sum of over, times scale. With an error
    bound, a share of the answer, the smallest sample is taken whose predicted error meets it."""

    table: str
    agg: str
    value: str
    where: str | None = None
    group_by: tuple[str, ...] = ()
    where_columns: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()
    over: str | None = None
    scale: float = 1.0
    error_bound: float | None = None

    @property
    def name(self) -> str:
        return self.agg

    def columns(self) -> set[str]:
        """The columns that the query filters or groups by."""
        return {*self.where_columns, *self.group_by}

    def joined(self, tables: dict[str, DataFrame]) -> DataFrame:
        df = tables[self.table]
        for j in self.joins:
            df = df.join(tables[j.table], F.col(j.left) == F.col(j.right))
        return df

    def exact(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The query over whole tables; Catalyst plans it."""
        df = self.joined(tables)
        if self.where:
            df = df.where(self.where)
        value = F.expr(self.value)
        if self.agg == "ratio":
            out = F.try_divide(F.sum(value), F.sum(F.expr(self.over))) * self.scale
        else:
            out = {"avg": F.avg, "sum": F.sum, "count": F.count}[self.agg](value)
        return df.groupBy(*self.group_by).agg(out.alias(self.name))

    def sql(self) -> str:
        select = f"{self.scale} * sum({self.value}) / sum({self.over})" if self.agg == "ratio" else f"{self.agg}({self.value})"
        keys = ", ".join(self.group_by)
        tables = self.table + "".join(f" JOIN {j.table} ON {j.left} = {j.right}" for j in self.joins)
        return f"SELECT {keys + ', ' if keys else ''}{select} AS {self.name} FROM {tables}" + (f" WHERE {self.where}" if self.where else "") + (f" GROUP BY {keys}" if keys else "")

    def over_table(self, table: str) -> Query:
        return replace(self, table=table)


@dataclass(frozen=True)
class Workload:
    """The columns that the pool's queries are on: a group with some of its values, a count and a size."""

    table: str
    group: str
    values: tuple[str, ...]
    count: str
    size: str


#: The groups that hourly page counts are asked about, and the bounds of counts and sizes.
PAGE_COUNTS = Workload("pagecounts", "project_name", ("'aa'", "'uk'", "'www'", "'kk'", "'zh.d'", "'th.mw'", "'en.mw'"), "page_count", "page_size")
COUNT_BOUNDS = (1, 2, 3, 4, 15)
SIZE_BOUNDS = (6000, 7000, 8000, 9000, 10000, 12000, 16000, 23000, 36000, 80000)

FACT = "lineitem"
#: The same queries on the benchmark's fact table.
LINEITEM = Workload(FACT, "l_suppkey", ("1", "2", "3", "4", "5", "6", "7"), "l_quantity", "l_extendedprice")


def pool(w: Workload = LINEITEM) -> list[Query]:
    """The 60 queries, by aggregate, then text. Each of AVG, SUM and COUNT of the count is asked without a filter (3
    queries in all), with a bound of the size (9), of the count (9), for each group (21) and with bounds of both (9); of
    count and of size by group (6); and of the count by group with a bound (3)."""
    n, c = SIZE_BOUNDS, COUNT_BOUNDS
    filters = [(None, ())]
    filters += [(f"{w.size} {op} {v}", (w.size,)) for op, v in (("<", n[1]), (">", n[5]), (">=", n[9]))]
    filters += [(f"{w.count} {op} {v}", (w.count,)) for op, v in ((">", c[0]), ("<", c[3]), (">=", c[4]))]
    filters += [(f"{w.group} = {v}", (w.group,)) for v in w.values]
    both = ((">", n[2], ">=", c[2]), (">", n[5], "<", c[3]), ("<", n[6], "<=", c[1]))
    filters += [(f"{w.size} {a} {x} AND {w.count} {b} {y}", (w.size, w.count)) for a, x, b, y in both]
    out = []
    for agg in ("avg", "sum", "count"):
        out += [Query(w.table, agg, w.count, where, where_columns=columns) for where, columns in filters]
        out += [Query(w.table, agg, value, group_by=(w.group,)) for value in (w.count, w.size)]
        out.append(Query(w.table, agg, w.count, f"{w.count} > {c[0]}", (w.group,), (w.count,)))
    return sorted(out, key=lambda q: (q.agg, q.sql()))


def except_columns(queries: list[Query], where: set[str], group_by: set[str] = frozenset()) -> list[Query]:
    """Queries that don't filter by any of the one set nor group by any of the other."""
    return [q for q in queries if not {*q.where_columns} & where and not {*q.group_by} & group_by]


def only_columns(queries: list[Query], where: set[str], group_by: set[str] = frozenset()) -> list[Query]:
    """Queries that filter by any of the one set and don't group by any of the other."""
    return [q for q in queries if {*q.where_columns} & where and not {*q.group_by} & group_by]


def equality_pool(w: Workload = LINEITEM) -> list[Query]:
    """AVG and SUM of the size at one count each, 3 to 10."""
    return [Query(w.table, a, w.size, f"{w.count} = {c}", where_columns=(w.count,)) for a in ("avg", "sum") for c in range(3, 11)]


REVENUE = "l_extendedprice * (1 - l_discount)"
Q6 = Query(FACT, "sum", "l_extendedprice * l_discount", "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
Q14 = Query(FACT, "ratio", f"CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END", "l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'", joins=(Join("part", "l_partkey", "p_partkey"),), over=REVENUE, scale=100.0)
Q19 = Query(
    FACT, "sum", REVENUE,
    "(p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 50)"
    " OR (p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 50)"
    " OR (p_brand = 'Brand#14' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size IN (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50))",
    joins=(Join("part", "l_partkey", "p_partkey"),),
)
