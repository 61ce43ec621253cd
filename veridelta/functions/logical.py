"""Logical types: what of a Spark type matters when values are compared."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALPHANUM_PATTERN = r"^[0-9A-Za-z_\-]+$"
SAMPLE_ROWS = 64


@dataclass(frozen=True)
class LogicalType:
    """kind: integer decimal float boolean timestamp timestamp_ntz date time text
    uuid alphanum json array struct unknown; precision: digits that count."""

    kind: str
    precision: int = 0
    rounds: bool = True
    name: str = ""
    upper: bool = False

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "decimal", "float", "boolean")

    @property
    def fractional(self) -> bool:
        return self.kind in ("integer", "decimal", "float")

    @property
    def temporal(self) -> bool:
        return self.kind in ("timestamp", "timestamp_ntz", "date", "time")

    @property
    def family(self) -> str:
        if self.numeric:
            return "number"
        if self.kind in ("timestamp", "timestamp_ntz"):
            return "timestamp"
        return "text" if self.kind in ("text", "uuid", "alphanum") else self.kind

    @property
    def key_kind(self) -> str | None:
        """The kind of a key's values; None if such values are no keys."""
        if self.kind == "integer" or self.kind == "decimal" and self.precision == 0:
            return "int"
        return {"decimal": "decimal", "uuid": "uuid", "alphanum": "alphanum"}.get(self.kind)


def binary_digits(bits: int) -> int:
    """Decimal digits that a mantissa of so many bits holds."""
    return math.floor(math.log10(2**bits))


_KINDS = {
    T.StringType: "text",
    T.BooleanType: "boolean",
    T.DateType: "date",
    T.ArrayType: "array",
    T.StructType: "struct",
    T.MapType: "struct",
    T.VariantType: "json",
}


def logical_type(dtype: T.DataType) -> LogicalType:
    name = dtype.simpleString()
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return LogicalType("integer", 0, name=name)
    if isinstance(dtype, T.DecimalType):
        return LogicalType("decimal", dtype.scale, name=name)
    if isinstance(dtype, T.FloatType):
        return LogicalType("float", binary_digits(24) - 2, name=name)
    if isinstance(dtype, T.DoubleType):
        return LogicalType("float", binary_digits(53) - 2, name=name)
    if isinstance(dtype, T.TimestampType):
        return LogicalType("timestamp", 6, name=name)
    if isinstance(dtype, T.TimestampNTZType):
        return LogicalType("timestamp_ntz", 6, name=name)
    if hasattr(T, "TimeType") and isinstance(dtype, T.TimeType):
        return LogicalType("time", 6, name=name)
    for kind, logical in _KINDS.items():
        if isinstance(dtype, kind):
            return LogicalType(logical, name=name)
    return LogicalType("unknown", name=name)


def logical_schema(df: DataFrame) -> dict[str, LogicalType]:
    return {f.name: logical_type(f.dataType) for f in df.schema}


def refined(df: DataFrame, schema: dict[str, LogicalType], columns: list[str]) -> dict[str, LogicalType]:
    """Text columns whose sampled values are all UUIDs or all alphanumeric get that
    type. One job reads a few rows; nulls tell nothing."""
    texts = [c for c in columns if schema[c].kind == "text"]
    if not texts:
        return schema
    rows = df.select(*(F.col(f"`{c}`") for c in texts)).limit(SAMPLE_ROWS)
    tests = []
    for i, c in enumerate(texts):
        col = F.col(f"`{c}`")
        tests += [
            F.count(col).alias(f"n{i}"),
            F.count_if(F.trim(col).rlike(UUID_PATTERN)).alias(f"u{i}"),
            F.count_if(F.trim(col).rlike(UUID_PATTERN) & (col == F.upper(col))).alias(f"p{i}"),
            F.count_if(col.rlike(ALPHANUM_PATTERN)).alias(f"a{i}"),
        ]
    got, out = rows.agg(*tests).first(), dict(schema)
    for i, c in enumerate(texts):
        if got[f"n{i}"] and got[f"n{i}"] == got[f"u{i}"]:
            out[c] = replace(schema[c], kind="uuid", upper=got[f"p{i}"] == got[f"n{i}"])
        elif got[f"n{i}"] and got[f"n{i}"] == got[f"a{i}"]:
            out[c] = replace(schema[c], kind="alphanum")
    return out


def mutual(a: LogicalType, b: LogicalType, names: tuple[str, str] = ("a", "b")) -> tuple[LogicalType, LogicalType]:
    """Both types at the precision that both hold; the coarser side's rounding wins."""
    if a.family != b.family and "unknown" not in (a.kind, b.kind):
        raise TypeError(f"columns {names[0]} ({a.name}) and {names[1]} ({b.name}) can't be compared")
    if a.family == "timestamp" or a.kind == b.kind == "time":
        coarse = b if b.precision < a.precision else a
        return (replace(a, precision=coarse.precision, rounds=coarse.rounds), replace(b, precision=coarse.precision, rounds=coarse.rounds))
    if a.fractional and b.fractional:
        p = min(a.precision, b.precision)
        return replace(a, precision=p), replace(b, precision=p)
    for t, n in ((a, names[0]), (b, names[1])):
        if t.kind in ("unknown",):
            warnings.warn(f"column {n} has type {t.name}, which is compared as text", stacklevel=2)
    return a, b
