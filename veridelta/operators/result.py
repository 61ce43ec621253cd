"""Results of a diff: statistics, text and JSON reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .schema_diff import kinds


def key_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: exclusive_a, exclusive_b, updated, by the signs (the first column) that
    each key has."""
    op = F.col(f"`{rows.columns[0]}`")
    cells = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    signs = rows.groupBy(*cells).agg(F.max((op == "-").cast("int")).alias("m"), F.max((op == "+").cast("int")).alias("p"))
    return signs.agg(
        F.count_if(F.expr("m = 1 and p = 0")).alias("exclusive_a"),
        F.count_if(F.expr("m = 0 and p = 1")).alias("exclusive_b"),
        F.count_if(F.expr("m = 1 and p = 1")).alias("updated"),
    )


class DiffResult:
    """Lazy rows, the sign and the columns, with their reports."""

    def __init__(self, rows: DataFrame, keys: list[str], count_a, count_b, extra: dict[str, Any] | None = None, sources=None, algorithm: str = ""):
        self.df, self.keys, self._counts = rows, keys, (count_a, count_b)
        self.extra, self.sources, self.algorithm = extra or {}, sources, algorithm

    def __iter__(self) -> Iterator[tuple[str, tuple]]:
        for row in self.df.toLocalIterator():
            yield row[0], tuple(row[1:])

    def ordered(self) -> DataFrame:
        """The rows by their keys' text, ``-`` before ``+``."""
        return self.df.orderBy(*(F.col(f"`{k}`").cast("string") for k in self.keys), F.col(f"`{self.df.columns[0]}`").desc())

    @cached_property
    def stats(self) -> dict[str, Any]:
        n1, n2 = (c() for c in self._counts)
        got = key_stats(self.df, self.keys).first().asDict()
        unchanged = n1 - got["exclusive_a"] - got["updated"]
        most = max(n1, n2)
        return {
            "rows_A": n1,
            "rows_B": n2,
            "exclusive_A": got["exclusive_a"],
            "exclusive_B": got["exclusive_b"],
            "updated": got["updated"],
            "unchanged": unchanged,
            "total": got["exclusive_a"] + got["exclusive_b"] + got["updated"],
            "stats": {"diff_percent": 1 - unchanged / most if most else 0.0, **self.extra},
        }

    def text_stats(self) -> str:
        s = self.stats
        lines = [
            f"{s['rows_A']} rows in table A",
            f"{s['rows_B']} rows in table B",
            f"{s['exclusive_A']} rows exclusive to table A (not present in B)",
            f"{s['exclusive_B']} rows exclusive to table B (not present in A)",
            f"{s['updated']} rows updated",
            f"{s['unchanged']} rows unchanged",
            f"{100 * s['stats']['diff_percent']:.2f}% difference score",
        ]
        more = {k: v for k, v in s["stats"].items() if k != "diff_percent"}
        return "\n".join(lines + (["", "Extra-Info:"] + [f"  {k} = {v}" for k, v in sorted(more.items())] if more else []))

    def text_rows(self, colour: bool = False, limit: int | None = None) -> Iterator[str]:
        for i, (op, values) in enumerate(self):
            if limit is not None and i >= limit:
                break
            line = f"{op} {', '.join(str(v) for v in values)}"
            yield f"\033[{31 if op == '-' else 32}m{line}\033[0m" if colour else line

    def json_lines(self) -> DataFrame:
        """One column ``value``: ["-", ["..."]] for each row."""
        cells = F.to_json(F.array(*(F.col(f"`{c}`") for c in self.df.columns[1:])))
        return self.df.select(F.concat(F.lit('["'), F.col(f"`{self.df.columns[0]}`"), F.lit('", '), cells, F.lit("]")).alias("value"))


def number_to_human(n: float) -> str:
    for size, unit in ((1e9, "b"), (1e6, "m"), (1e3, "k")):
        if abs(n) >= size:
            return f"{n / size:.0f}{unit}"
    return f"{n:.0f}"


def wide_rows(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a wide diff as one JSON text each: exclusive or diff, with every value's
    isPK, isDiff, dataset1 and dataset2."""
    values = []
    for c in [*keys, *(x for x in columns if x not in keys)]:
        a, b = F.col(f"`{c}_a`"), F.col(f"`{c}_b`")
        if c in keys:
            values += [F.lit(c), F.struct(F.lit(True).alias("isPK"), F.lit(False).alias("isDiff"), F.coalesce(a, b).alias("dataset1"), F.coalesce(b, a).alias("dataset2"))]
        else:
            values += [F.lit(c), F.struct(F.lit(False).alias("isPK"), (F.col(f"`is_diff_{c}`") == 1).alias("isDiff"), a.alias("dataset1"), b.alias("dataset2"))]
    kind = F.when(F.col("is_exclusive_a") == 1, "exclusive1").when(F.col("is_exclusive_b") == 1, "exclusive2").otherwise("diff")
    return wide.select(kind.alias("kind"), F.to_json(F.create_map(*values), {"ignoreNullFields": "false"}).alias("row"))


#: Rows that one JSON document holds; ``wide_rows`` writes any number of them to a sink.
REPORT_ROWS = 100_000


def json_report(differ, result: DiffResult, names: tuple[str, str], with_summary: bool = True, with_columns: bool = True, limit: int = REPORT_ROWS) -> dict:
    """The JSON document, version 1.1.0, of a join diff. Of more than ``limit`` rows
    the document tells how many it leaves out (``rows.omitted``)."""
    found = wide_rows(differ.wide(), differ.key_names, differ.names)
    got: list[Row] = found.limit(limit + 1).collect()
    omitted = found.count() - limit if len(got) > limit else 0
    got = got[:limit]
    rows: dict[str, Any] = {"exclusive": {"dataset1": [], "dataset2": []}, "diff": []} | ({"omitted": omitted} if omitted else {})
    for r in got:
        value = json.loads(r["row"])
        if r["kind"] == "diff":
            rows["diff"].append(value)
        else:
            rows["exclusive"]["dataset" + r["kind"][-1]].append({k: {"isPK": v["isPK"], "value": v["dataset" + r["kind"][-1]]} for k, v in value.items()})
    out: dict[str, Any] = {"version": "1.1.0", "status": "success", "result": "different" if got else "identical", "dataset1": names[0], "dataset2": names[1], "rows": rows}
    if with_summary:
        s = result.stats
        out["summary"] = {
            "rows": {"total": {"dataset1": s["rows_A"], "dataset2": s["rows_B"]}, "exclusive": {"dataset1": s["exclusive_A"], "dataset2": s["exclusive_B"]}, "updated": s["updated"], "unchanged": s["unchanged"]},
            "stats": {"diffCounts": differ.diff_counts().first().asDict()},
        }
    if with_columns:
        a, b = kinds(differ.a.df), kinds(differ.b.df)
        listed = lambda df, k: [{"name": f.name, "type": f.dataType.simpleString(), "kind": k[f.name]} for f in df.schema]
        shared = {f.name: f.dataType for f in differ.a.df.schema}
        out["columns"] = {
            "dataset1": listed(differ.a.df, a),
            "dataset2": listed(differ.b.df, b),
            "primaryKey": differ.key_names,
            "exclusive": {"dataset1": [c for c in a if c not in b], "dataset2": [c for c in b if c not in a]},
            "typeChanged": [f.name for f in differ.b.df.schema if f.name in shared and shared[f.name] != f.dataType],
        }
    return out


def json_error(error: BaseException, names: tuple[str, str] = ("", "")) -> dict:
    return {"version": "1.0.0", "status": "failed", "dataset1": names[0], "dataset2": names[1], "error": f"{type(error).__name__}: {error}"}
