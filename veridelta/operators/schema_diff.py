"""Differences of two schemas, and columns by pattern."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from veridelta.functions.logical import logical_schema


def schema_diff(a: DataFrame, b: DataFrame, case_sensitive: bool = True) -> dict[str, list]:
    fold = (lambda c: c) if case_sensitive else str.lower
    left, right = ({fold(f.name): f.dataType.simpleString() for f in x.schema} for x in (a, b))
    return {
        "removed": [c for c in left if c not in right],
        "added": [c for c in right if c not in left],
        "changed": [(c, left[c], right[c]) for c in left if c in right and left[c] != right[c]],
    }


def schema_diff_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """column_name, change (added, removed, type), type_a, type_b."""
    found = schema_diff(a, b)
    left, right = ({f.name: f.dataType.simpleString() for f in x.schema} for x in (a, b))
    rows = [(c, "removed", left[c], None) for c in found["removed"]] + [(c, "added", None, right[c]) for c in found["added"]]
    rows += [(c, "type", x, y) for c, x, y in found["changed"]]
    return a.sparkSession.createDataFrame(rows, "column_name string, change string, type_a string, type_b string")


def matching(pattern: str, names: list[str]) -> list[str]:
    """Names that fit: ``%`` is any text, ``?`` one character."""
    parts = re.split(r"([%?])", pattern)
    expr = "".join({"%": ".*", "?": "."}.get(p, re.escape(p)) for p in parts)
    return [n for n in names if re.fullmatch(expr, n)]


def expand(patterns: list[str], a: DataFrame, b: DataFrame, skip: set[str] = frozenset()) -> list[str]:
    """Columns of both tables that the patterns name, in order."""
    mutual = [c for c in a.columns if c in b.columns]
    out: list[str] = []
    for p in patterns:
        got = matching(p, mutual)
        if not got:
            side = "first" if not matching(p, a.columns) else "second"
            raise ValueError(f"no column of the {side} table fits {p!r}")
        out += got
    return [c for c in dict.fromkeys(out) if c not in skip]


def kinds(df: DataFrame) -> dict[str, str]:
    """Coarse kind of every column, for reports."""
    names = {"decimal": "float", "timestamp": "datetime", "timestamp_ntz": "datetime", "time": "datetime", "text": "string", "uuid": "string", "alphanum": "string"}
    known = {"integer", "float", "date", "boolean"}
    return {c: names.get(t.kind, t.kind if t.kind in known else "unsupported") for c, t in logical_schema(df).items()}
