"""A side of a comparison: a table, its keys and the part that is compared."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import checksum as C
from veridelta.functions.keyspace import ArithmeticKey, Vector, checkpoints, mesh, space_size
from veridelta.functions.logical import LogicalType, logical_schema, refined
from veridelta.functions.normalize import normalize


def _literal(v: Any) -> Column:
    return F.lit(str(v) if isinstance(v, ArithmeticKey) else v)


@dataclass(frozen=True)
class Segment:
    """Bounds are half open. Rows with a null key fall outside every key bound."""

    df: DataFrame
    keys: tuple[str, ...] = ("id",)
    update_column: str | None = None
    extras: tuple[str, ...] = ()
    ignored: frozenset[str] = frozenset()
    min_key: Vector | None = None
    max_key: Vector | None = None
    min_update: Any = None
    max_update: Any = None
    where: str | None = None
    case_sensitive: bool = True
    schema: dict[str, LogicalType] | None = field(default=None, compare=False)
    unique: frozenset[str] = frozenset()

    def __post_init__(self):
        if not self.update_column and (self.min_update is not None or self.max_update is not None):
            raise ValueError("update bounds need an update column")
        for low, high, what in ((self.min_key, self.max_key, "key"), (self.min_update, self.max_update, "update")):
            if low is not None and high is not None and not low < high:
                raise ValueError(f"the lower {what} bound must be below the upper one")
        names = {c: c for c in self.df.columns}
        folded: dict[str, list[str]] = {}
        for c in self.df.columns:
            folded.setdefault(c.lower(), []).append(c)

        def found(c: str) -> str:
            if c in names:
                return c
            near = folded.get(c.lower(), [])
            if self.case_sensitive or not near:
                raise ValueError(f"column {c!r} is not in the table ({', '.join(self.df.columns)})")
            if len(near) > 1:
                raise ValueError(f"column {c!r} could be any of {near}")
            return near[0]

        set_ = object.__setattr__
        set_(self, "keys", tuple(map(found, self.keys)))
        set_(self, "extras", tuple(found(c) for c in self.extras))
        if self.update_column:
            set_(self, "update_column", found(self.update_column))
        if self.schema is None:
            set_(self, "schema", logical_schema(self.df))

    @property
    def columns(self) -> list[str]:
        """Keys, the update column, the rest; each once."""
        return list(dict.fromkeys([*self.keys, *([self.update_column] if self.update_column else []), *self.extras]))

    def with_types(self) -> Segment:
        """Sample text columns for UUIDs and alphanumeric keys."""
        return replace(self, schema=refined(self.rows(), self.schema, self.columns))

    def rows(self) -> DataFrame:
        """The rows inside all bounds; every test can reach the scan."""
        df = self.df
        if self.where:
            df = df.filter(F.expr(f"({self.where})"))
        for bound, test in ((self.min_key, lambda c, v: c >= v), (self.max_key, lambda c, v: c < v)):
            for k, v in zip(self.keys, bound or ()):
                df = df.filter(test(F.col(f"`{k}`"), _literal(v)))
        if self.min_update is not None:
            df = df.filter(F.col(f"`{self.update_column}`") >= _literal(self.min_update))
        if self.max_update is not None:
            df = df.filter(F.col(f"`{self.update_column}`") < _literal(self.max_update))
        return df

    def text(self, column: str) -> Column:
        return normalize(F.col(f"`{column}`"), self.schema[column])

    def checked(self) -> list[str]:
        return [c for c in self.columns if c not in self.ignored]

    def count(self) -> int:
        return self.rows().count()

    def count_and_checksum(self) -> tuple[int, int | None]:
        got = self.rows().agg(F.count("*").alias("n"), C.checksum([self.text(c) for c in self.checked()]).alias("s")).first()
        return got["n"], None if got["s"] is None else int(got["s"])

    def key_range(self) -> tuple[Vector, Vector]:
        """Least and greatest value of every key, in one pass."""
        aggs = [f(f"`{k}`").alias(f"{n}{i}") for i, k in enumerate(self.keys) for n, f in (("low", F.min), ("high", F.max))]
        got = self.rows().agg(*aggs).first()
        if any(v is None for v in got):
            raise ValueError("the table is empty, or a key has only nulls")
        n = range(len(self.keys))
        return Vector(tuple(got[f"low{i}"] for i in n)), Vector(tuple(got[f"high{i}"] for i in n))

    def approximate_size(self) -> int:
        if self.min_key is None or self.max_key is None:
            raise ValueError("the segment has no key bounds")
        return space_size(self.min_key, self.max_key)

    def segments(self, count: int) -> list[Segment]:
        """The boxes that about ``count`` even points make."""
        boxes = mesh(checkpoints(self.min_key, self.max_key, count))
        return [replace(self, min_key=a, max_key=b) for a, b in boxes]

    def bounded(self, low: Vector, high: Vector) -> Segment:
        if self.min_key is not None and not self.min_key <= low or self.max_key is not None and not high <= self.max_key:
            raise ValueError("the new bounds leave the segment")
        return replace(self, min_key=low, max_key=high)
