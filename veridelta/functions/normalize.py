"""Canonical text of values: equal values on two sides become equal strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logical import LogicalType


def number_text(col: Column, precision: int, floating: bool = False) -> Column:
    """Exactly ``precision`` decimals; what no decimal holds keeps its own text."""
    fixed = col.try_cast(f"decimal(38,{precision})").cast("string")
    if not floating:
        return fixed
    odd = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(odd, col.cast("string")).otherwise(F.coalesce(fixed, col.cast("string")))


def boolean_text(col: Column) -> Column:
    return col.cast("int").cast("string")


def timestamp_text(col: Column, precision: int = 6, rounds: bool = True) -> Column:
    """26 characters; lost digits are rounded half up, or cut, in whole micros."""
    ts = col.cast("timestamp")
    if precision >= 6:
        return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    unit = 10 ** (6 - precision)
    micros = F.unix_micros(ts) + (unit // 2 if rounds else 0)
    return F.date_format(F.timestamp_micros(micros - F.pmod(micros, F.lit(unit))), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def date_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def time_text(col: Column, precision: int = 6, rounds: bool = True) -> Column:
    """``HH:mm:ss.ffffff`` of a TIME or of its text."""
    return timestamp_text(F.concat(F.lit("1970-01-01 "), col.cast("string")).cast("timestamp"), precision, rounds).substr(12, 15)


def uuid_text(col: Column) -> Column:
    return F.trim(col.cast("string"))


def json_text(col: Column) -> Column:
    """Text of a JSON value, keys sorted and numbers canonical; text that is no JSON
    stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(col.cast("string"))), col.cast("string"))


def complex_text(col: Column) -> Column:
    return F.to_json(col, {"ignoreNullFields": "false"})


def normalize(col: Column, kind: LogicalType) -> Column:
    """The canonical string of a value; null stays null."""
    match kind.kind:
        case "timestamp" | "timestamp_ntz":
            return timestamp_text(col, kind.precision, kind.rounds)
        case "date":
            return date_text(col)
        case "time":
            return time_text(col, kind.precision, kind.rounds)
        case "float":
            return number_text(col.cast("double"), kind.precision, floating=True)
        case "decimal":
            return number_text(col, kind.precision)
        case "boolean":
            return boolean_text(col)
        case "uuid":
            return uuid_text(col)
        case "json":
            return F.to_json(col)
        case "array" | "struct":
            return complex_text(col)
        case _:
            return col.cast("string")


def comparable(col: Column, kind: LogicalType) -> Column:
    """The raw value, as text where Spark has no order for it."""
    return normalize(col, kind) if kind.kind in ("json", "struct", "array") else col


def as_text(col: Column, kind: LogicalType) -> Column:
    """The canonical string of what ``comparable`` gave."""
    return col if kind.kind in ("json", "struct", "array") else normalize(col, kind)
