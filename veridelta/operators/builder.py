"""A small fluent facade over DataFrames for the relational operators.

``table(df)`` is a relation; ``this.x`` a column bound when used. Clauses add up;
None and SKIP drop out. Catalyst merges, prunes and orders them.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from types import GeneratorType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.errors import QueryBuildError

SKIP = object()


class _This:
    """Late-bound columns: ``this.x``, ``this["x"]``, ``this[["x", "y"]]``."""

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"`{name}`")

    def __getitem__(self, name: str | list[str]):
        return [self[n] for n in name] if isinstance(name, list) else F.col(f"`{name}`")


this = _This()


def _flat(items: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    for x in items:
        if isinstance(x, (list, tuple, GeneratorType)):
            out += _flat(x)
        elif x is not None and x is not SKIP:
            out.append(F.col(f"`{x}`") if isinstance(x, str) else x)
    return out


def _named(exprs, named) -> list[Column]:
    return _flat(exprs) + [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in named.items() if v is not SKIP]


def and_(*preds) -> Column:
    return reduce(lambda a, b: a & b, _flat(preds))


def or_(*preds) -> Column:
    return reduce(lambda a, b: a | b, _flat(preds))


def is_distinct_from(a: Column, b: Any) -> Column:
    return ~a.eqNullSafe(b)


def in_(a: Column, values: Iterable) -> Column:
    return a.isin(list(values))


def equals(a: Column, b: Any) -> Column:
    return a.isNull() if b is None else a == b


class _When:
    def __init__(self, done: list[tuple[Column, Any]], test: Column | None):
        self.done, self.test = done, test

    def then(self, value: Any) -> _When:
        if self.test is None:
            raise QueryBuildError("then() needs a when() before it")
        return _When([*self.done, (self.test, value)], None)

    def when(self, *tests) -> _When:
        if self.test is not None:
            raise QueryBuildError("when() needs a then() before the next")
        return _When(self.done, and_(*tests))

    def else_(self, value: Any) -> Column:
        return self.column().otherwise(value)

    def column(self) -> Column:
        if self.test is not None or not self.done:
            raise QueryBuildError("a when() lacks its then()")
        out = F.when(*self.done[0])
        for test, value in self.done[1:]:
            out = out.when(test, value)
        return out


def when(*tests) -> _When:
    return _When([], and_(*tests))


def if_(test: Column, then: Any, else_: Any = None) -> Column:
    return F.when(test, then).otherwise(F.lit(else_))


def code(sql: str, **columns: str) -> Column:
    """SQL text with {names} filled in."""
    return F.expr(sql.format(**columns))


def bool_to_int(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


class Relation:
    def __init__(self, df: DataFrame):
        self.df = df

    def __getitem__(self, name: str) -> Column:
        return self.df[name]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def select(self, *exprs, distinct: bool = False, hints: str | None = None, **named) -> Relation:
        df = self.df.hint(hints) if hints else self.df
        columns = _named(exprs, named)
        df = df.select(*columns) if columns else df
        return Relation(df.distinct() if distinct else df)

    def where(self, *preds) -> Relation:
        tests = _flat(preds)
        return Relation(self.df.filter(and_(*tests))) if tests else self

    def order_by(self, *exprs) -> Relation:
        return Relation(self.df.orderBy(*_flat(exprs)))

    def limit(self, n: int) -> Relation:
        return Relation(self.df.limit(n))

    def sample(self, n: int, seed: int | None = None) -> Relation:
        return Relation(self.df.orderBy(F.rand(seed)).limit(n))

    def alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name))

    def cte(self, *names: str) -> Relation:
        """A named subquery; ``names`` rename its columns."""
        return Relation(self.df.toDF(*names)) if names else self

    def at(self, *exprs) -> Relation:
        return self.select(*exprs)

    def join(self, *others: Relation) -> Join:
        return Join("inner", self, *others)

    def group_by(self, *keys, **named) -> Grouped:
        return Grouped(self, _named(keys, named), [])

    def count(self) -> int:
        return self.df.count()

    def union(self, other: Relation) -> Relation:
        return Relation(self.df.union(other.df).distinct())

    def union_all(self, other: Relation) -> Relation:
        return Relation(self.df.unionAll(other.df))

    def minus(self, other: Relation) -> Relation:
        return Relation(self.df.subtract(other.df))

    def intersect(self, other: Relation) -> Relation:
        return Relation(self.df.intersect(other.df))

    def exists(self, other: Relation, on: Column) -> Relation:
        return Relation(self.df.join(other.df, on, "left_semi"))

    def not_exists(self, other: Relation, on: Column) -> Relation:
        return Relation(self.df.join(other.df, on, "left_anti"))

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def query(self, kind: Any = list) -> Any:
        """Run it: int, tuple, list, [int], [str], [tuple] or [dict]."""
        if kind is int:
            row = self.df.first()
            if row is None:
                raise QueryBuildError("no row to take a number from")
            return None if row[0] is None else int(row[0])
        if kind is tuple:
            row = self.df.first()
            return None if row is None else tuple(row)
        rows = self.df.collect()
        args = getattr(kind, "__args__", (tuple,))
        if args[0] is dict:
            return [r.asDict() for r in rows]
        return [tuple(r) for r in rows] if args[0] is tuple else [args[0](r[0]) for r in rows]


def table(df: DataFrame) -> Relation:
    return Relation(df)


class Join:
    """Relations joined from left to right; without ``on`` all pairs (explicitly)."""

    def __init__(self, how: str, *relations: Relation):
        self.how, self.relations, self.tests = how, relations, []

    def on(self, *preds) -> Join:
        out = Join(self.how, *self.relations)
        out.tests = self.tests + _flat(preds)
        return out

    def select(self, *exprs, **named) -> Relation:
        first, *rest = (r.df for r in self.relations)
        df = first
        tests = list(self.tests)
        for i, other in enumerate(rest):
            last = i == len(rest) - 1
            use = tests if last else tests[:1]
            tests = tests[len(use) :]
            df = df.join(other, and_(*use), self.how) if use else df.crossJoin(other)
        return Relation(df).select(*exprs, **named)


def join(*relations: Relation) -> Join:
    return Join("inner", *relations)


def leftjoin(*relations: Relation) -> Join:
    return Join("left", *relations)


def rightjoin(*relations: Relation) -> Join:
    return Join("right", *relations)


def outerjoin(*relations: Relation) -> Join:
    return Join("full_outer", *relations)


class Grouped:
    def __init__(self, relation: Relation, keys: list[Column], tests: list[Column]):
        self.relation, self.keys, self.tests = relation, keys, tests

    def having(self, *preds) -> Grouped:
        return Grouped(self.relation, self.keys, self.tests + _flat(preds))

    def agg(self, *exprs, **named) -> Aggregated:
        columns = _named(exprs, named)
        if not columns:
            raise QueryBuildError("group_by() needs agg()")
        df = self.relation.df.groupBy(*self.keys).agg(*columns)
        return Aggregated(df.filter(and_(*self.tests)) if self.tests else df)

    def select(self, *_, **__):
        raise QueryBuildError("group_by() needs agg()")


class Aggregated(Relation):
    def having(self, *preds) -> Relation:
        return self.where(*preds)


coalesce, sum_, avg, min_, max_, count, count_distinct, func = F.coalesce, F.sum, F.avg, F.min, F.max, F.count, F.count_distinct, F.call_function
current_timestamp = F.current_timestamp
current_database, current_schema = F.current_database, F.current_schema


def select_one(spark: SparkSession, *exprs, **named) -> Relation:
    """A select without a table: one row."""
    return Relation(spark.range(1).select(*_named(exprs, named)))


def with_params(spark: SparkSession, sql: str, **params: Any) -> Relation:
    """SQL text whose ``:name`` marks are bound to values, never pasted."""
    return Relation(spark.sql(sql, args=params))


def run_all(queries: Iterable[Relation] | Generator, kind: Any = list) -> list:
    """Results of queries run one after another. A generator gets each result back
    where it yielded the query, and what it returns is the last one."""
    if not isinstance(queries, GeneratorType):
        return [q.query(kind) for q in queries]
    out: list = []
    try:
        query = next(queries)
        while True:
            out.append(query.query(kind))
            query = queries.send(out[-1])
    except StopIteration as end:
        return out if end.value is None else [*out, end.value]


#: SQL types of Python ones.
TYPE_NAMES = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "STRING", bytes: "BINARY", date: "DATE", datetime: "TIMESTAMP", Decimal: "DECIMAL(38,18)"}


def type_name(kind: type | str) -> str:
    if isinstance(kind, str):
        return kind
    if kind not in TYPE_NAMES:
        raise QueryBuildError(f"no SQL type for {kind.__name__}")
    return TYPE_NAMES[kind]
