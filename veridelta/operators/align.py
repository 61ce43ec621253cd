"""Two segments as one pair: columns matched by position, types made mutual."""

from __future__ import annotations

from dataclasses import replace

from veridelta.errors import KeyTypesDiffer
from veridelta.functions.logical import LogicalType, mutual

from .segment import Segment


def with_precision(segment: Segment, digits: dict[str, int]) -> Segment:
    schema = {c: replace(t, precision=digits[c]) if c in digits else t for c, t in segment.schema.items()}
    return replace(segment, schema=schema)


def check_keys(a: Segment, b: Segment, strict: bool = False) -> None:
    """Same number of keys of the same kinds. Any comparable type may be a key
    unless ``strict``, which admits integers, decimals, UUIDs and alphanumerics."""
    if len(a.keys) != len(b.keys) or not a.keys:
        raise ValueError("both tables need the same number of keys, one at least")
    for x, y in zip(a.keys, b.keys):
        tx, ty = a.schema[x], b.schema[y]
        if strict:
            for t, n in ((tx, x), (ty, y)):
                if t.key_kind is None:
                    raise NotImplementedError(f"a column of type {t.name} can't be a key: {n}")
            if tx.key_kind != ty.key_kind:
                raise KeyTypesDiffer(f"keys {x} ({tx.name}) and {y} ({ty.name}) differ in kind")
        elif tx.family != ty.family:
            raise KeyTypesDiffer(f"keys {x} ({tx.name}) and {y} ({ty.name}) differ in kind")


def pairs(a: Segment, b: Segment) -> list[tuple[str, str]]:
    if len(a.columns) != len(b.columns):
        raise ValueError(f"unequal columns: {a.columns} and {b.columns}")
    return list(zip(a.columns, b.columns))


def reduced(a: Segment, b: Segment) -> tuple[Segment, Segment]:
    """Both at the precision that both sides hold."""
    left: dict[str, LogicalType] = dict(a.schema)
    right: dict[str, LogicalType] = dict(b.schema)
    for x, y in pairs(a, b):
        left[x], right[y] = mutual(a.schema[x], b.schema[y], (x, y))
    return replace(a, schema=left), replace(b, schema=right)
