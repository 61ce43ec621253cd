"""Checksums computed by the database itself.

For tables behind JDBC a comparison needs only the counts and sums of row hashes of
key ranges; these queries run in the database, and rows are read only of ranges that
disagree. The SQL gives the same canonical text and MD5 sums as ``functions``, so one
side may be a database and the other any table that Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from veridelta.functions.checksum import NULL_TEXT, OFFSET
from veridelta.functions.logical import LogicalType


@dataclass(frozen=True)
class Forms:
    """How a database words what the checksum needs: ``{x}`` is the operand."""

    md5: str  # the last 12 hex digits of the MD5 of a text, as a number
    date: str
    stamp: str
    text: str = "CAST({x} AS VARCHAR)"
    quote: str = '"'
    whole: str = "CAST({x} AS BIGINT)"


_TO_CHAR = "TO_CHAR({x}, 'YYYY-MM-DD')"
FORMS = {
    "postgresql": Forms("CAST(CAST(('x' || RIGHT(MD5({x}), 12)) AS BIT(48)) AS BIGINT)", _TO_CHAR, "TO_CHAR({x}, 'YYYY-MM-DD HH24:MI:SS.US')"),
    "redshift": Forms("STRTOL(RIGHT(MD5({x}), 12), 16)", _TO_CHAR, "TO_CHAR({x}, 'YYYY-MM-DD HH24:MI:SS.US')"),
    "snowflake": Forms("TO_NUMBER(RIGHT(MD5({x}), 12), 'XXXXXXXXXXXX')", _TO_CHAR, "TO_CHAR({x}, 'YYYY-MM-DD HH24:MI:SS.FF6')"),
    "mysql": Forms("CAST(CONV(RIGHT(MD5({x}), 12), 16, 10) AS SIGNED)", "DATE_FORMAT({x}, '%Y-%m-%d')", "DATE_FORMAT({x}, '%Y-%m-%d %H:%i:%s.%f')", "CAST({x} AS CHAR)", "`", "CAST({x} AS SIGNED)"),
    "duckdb": Forms("CAST('0x' || RIGHT(MD5({x}), 12) AS BIGINT)", "STRFTIME({x}, '%Y-%m-%d')", "STRFTIME({x}, '%Y-%m-%d %H:%M:%S.%f')"),
    "trino": Forms("FROM_BASE(SUBSTR(TO_HEX(MD5(TO_UTF8({x}))), 21), 16)", "DATE_FORMAT({x}, '%Y-%m-%d')", "DATE_FORMAT({x}, '%Y-%m-%d %H:%i:%s.%f')"),
}
FORMS["presto"] = FORMS["trino"]


class RemoteTable:
    """A table's range sums as SQL; ``run`` gives a query's rows as a DataFrame."""

    def __init__(self, kind: str, name: str, run: Callable[[str], DataFrame]):
        if kind not in FORMS:
            raise NotImplementedError(f"no checksum SQL for {kind!r}; known: {', '.join(FORMS)}")
        self.forms, self.name, self.run = FORMS[kind], name, run

    def column(self, name: str) -> str:
        q = self.forms.quote
        return q + name.replace(q, q + q) + q

    def text(self, name: str, kind: LogicalType) -> str:
        """The canonical text of a column."""
        x, f = self.column(name), self.forms
        match kind.kind:
            case "integer" | "uuid":
                return f.text.format(x=x)
            case "decimal":
                return f.text.format(x=f"CAST({x} AS DECIMAL(38,{kind.precision}))")
            case "text" | "alphanum":
                return x
            case "boolean":
                return f"CASE WHEN {x} THEN '1' WHEN NOT {x} THEN '0' END"
            case "date":
                return f.date.format(x=x)
            case "timestamp" | "timestamp_ntz" if kind.precision >= 6:
                return f.stamp.format(x=x)
        raise NotImplementedError(f"column {name} of type {kind.name} has no canonical text in this database's SQL")

    def row_text(self, texts: list[str]) -> str:
        if len(texts) == 1:
            return texts[0]
        parts = [f"COALESCE({x}, '{NULL_TEXT}')" for x in texts]
        if self.forms.quote == "`":
            return f"CONCAT_WS('|', {', '.join(parts)})"
        return " || '|' || ".join(parts)

    def where(self, key: str, intervals: list[tuple[int, int]] | None, more: str | None = None, nulls: bool = False) -> str:
        k = self.column(key)
        tests = [f"({more})"] if more else []
        if intervals is not None:
            inside = [f"({k} >= {low} AND {k} < {high})" for low, high in intervals] + ([f"{k} IS NULL"] if nulls else [])
            tests.append(f"({' OR '.join(inside)})" if inside else "1 = 0")
        elif not nulls:
            tests.append(f"{k} IS NOT NULL")
        return f" WHERE {' AND '.join(tests)}" if tests else ""

    def sums_sql(self, key: str, texts: list[str], low: int, size: int, intervals=None, more: str | None = None) -> str:
        """cell, n, s: count and sum of row hashes of each range of ``size`` keys."""
        k, f = self.column(key), self.forms
        cell = f.whole.format(x=f"(({k} - ({low})) - MOD({k} - ({low}), {size})) / {size}")
        h = f"CAST({f.md5.format(x=self.row_text(texts))} - {OFFSET} AS DECIMAL(38,0))"
        return f"SELECT {cell} AS cell, COUNT(*) AS n, SUM({h}) AS s FROM {self.name}{self.where(key, intervals, more)} GROUP BY {cell}"

    def ends_sql(self, key: str, more: str | None = None) -> str:
        k = self.column(key)
        return f"SELECT MIN({k}) AS low, MAX({k}) AS high FROM {self.name}{self.where(key, None, more, nulls=True)}"

    def rows_sql(self, columns: list[str], key: str, intervals, more: str | None = None) -> str:
        return f"SELECT {', '.join(map(self.column, columns))} FROM {self.name}{self.where(key, intervals, more, nulls=True)}"


def remote_table(source, name: str) -> RemoteTable:
    """``name`` of a JDBC source; queries run there."""
    return RemoteTable(source.kind, name, lambda sql: source.table(f"({sql})"))
