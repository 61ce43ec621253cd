"""diff_tables: the entry point of comparisons."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from .hashdiff import DEFAULT_FACTOR, DEFAULT_THRESHOLD, HashDiff
from .joindiff import JoinDiff
from .rangediff import RangeDiff
from .result import DiffResult
from .segment import Segment

AUTO, JOIN, HASH, RANGE = "auto", "joindiff", "hashdiff", "rangediff"
TABLE_WRITE_LIMIT = 1000


def as_segment(table: DataFrame | Segment, **options: Any) -> Segment:
    options = {k: v for k, v in options.items() if v is not None}
    if isinstance(table, Segment):
        return replace(table, **options)
    return Segment(table, **options)


def diff_tables(
    a: DataFrame | Segment,
    b: DataFrame | Segment,
    *,
    key_columns: tuple[str, ...] | None = None,
    update_column: str | None = None,
    extra_columns: tuple[str, ...] | None = None,
    min_key=None,
    max_key=None,
    min_update=None,
    max_update=None,
    where: str | None = None,
    algorithm: str = AUTO,
    bisection_factor: int = DEFAULT_FACTOR,
    bisection_threshold: int = DEFAULT_THRESHOLD,
    validate_unique_key: bool = True,
    sample_exclusive_rows: bool = False,
    materialize_to_table: str | None = None,
    materialize_all_rows: bool = False,
    table_write_limit: int | None = TABLE_WRITE_LIMIT,
    skip_null_keys: bool = False,
    strict_keys: bool = False,
    remote: bool = False,
    remote_tables: tuple = (None, None),
) -> DiffResult:
    """Compare two tables. ``auto`` joins where Spark reads both sides, and prunes by
    checksums where a side is ``remote``; ``rangediff`` prunes by ranges of an integer
    key, for tables sorted or partitioned by it, or with ``remote_tables`` (see
    ``sources.pushdown``) for databases, which then sum their rows themselves. Keys are validated before any row is
    returned; the table write limit applies in total (None: no limit), and what it
    leaves out is counted in the extra statistics."""
    from veridelta.functions.keyspace import Vector
    from veridelta.sources.sinks import name_from_template, write_table

    def vector(v):
        return v if v is None or isinstance(v, Vector) else Vector(tuple(v) if isinstance(v, (tuple, list)) else (v,))

    options = {
        "keys": key_columns and tuple(key_columns),
        "update_column": update_column,
        "extras": extra_columns and tuple(extra_columns),
        "min_key": vector(min_key),
        "max_key": vector(max_key),
        "min_update": min_update,
        "max_update": max_update,
        "where": where,
    }
    a, b = as_segment(a, **options), as_segment(b, **options)
    if algorithm == AUTO:
        algorithm = HASH if remote else JOIN
    if algorithm in (HASH, RANGE):
        options = {"factor": bisection_factor, "threshold": bisection_threshold, "strict_keys": strict_keys}
        differ = HashDiff(a, b, **options) if algorithm == HASH else RangeDiff(a, b, remote=remote_tables, **options)
        return DiffResult(differ.rows(), differ.keys, a.count, b.count, sources=differ, algorithm=algorithm)
    if algorithm != JOIN:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    differ = JoinDiff(a, b, skip_null_keys, strict_keys)
    extra: dict[str, Any] = differ.validate() if validate_unique_key else {}
    if sample_exclusive_rows:
        extra["exclusive_count"] = differ.exclusive_count().first()[0]
        extra["exclusive_sample"] = [tuple(r) for r in differ.sample_exclusive().collect()]
    if materialize_to_table:
        found = differ.wide(materialize_all_rows)
        write_table(found, name_from_template(materialize_to_table), table_write_limit)
        if table_write_limit is not None and (left := found.count() - table_write_limit) > 0:
            extra["rows_not_written"] = left
    return DiffResult(differ.rows(), differ.key_names, a.count, b.count, extra, differ, JOIN)
