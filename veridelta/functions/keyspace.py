"""Arithmetic over key values: points, boxes and buckets of a key space."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce, total_ordering
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In byte order, so Spark's binary order of strings is this order.
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_PLACE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_BASE = len(ALPHABET) + 1


@total_ordering
class ArithmeticKey:
    """A key that is a number underneath; + and - work on the number."""

    def number(self) -> int:
        raise NotImplementedError

    def moved(self, number: int) -> ArithmeticKey:
        raise NotImplementedError

    def __add__(self, n: int):
        return self.moved(self.number() + n)

    def __sub__(self, other):
        return self.number() - other.number() if isinstance(other, ArithmeticKey) else self.moved(self.number() - other)

    def __eq__(self, other):
        return isinstance(other, ArithmeticKey) and self.number() == other.number()

    def __lt__(self, other):
        return self.number() < other.number()

    def __hash__(self):
        return hash(self.number())


@dataclass(frozen=True, eq=False)
class UuidKey(ArithmeticKey):
    value: uuid.UUID
    upper: bool = False

    @classmethod
    def of(cls, text: str) -> UuidKey:
        return cls(uuid.UUID(text.strip()), text.upper() == text and text.lower() != text)

    def number(self) -> int:
        return self.value.int

    def moved(self, number: int) -> UuidKey:
        return UuidKey(uuid.UUID(int=max(0, min(number, (1 << 128) - 1))), self.upper)

    def __str__(self):
        return str(self.value).upper() if self.upper else str(self.value)


@dataclass(frozen=True, eq=False)
class AlphanumKey(ArithmeticKey):
    """Text over ALPHABET as a fraction: shorter texts are padded at their end."""

    text: str
    width: int

    @classmethod
    def pair(cls, a: str, b: str) -> tuple[AlphanumKey, AlphanumKey]:
        width = max(len(a), len(b))
        return cls(a, width), cls(b, width)

    def number(self) -> int:
        out = 0
        for c in self.text:
            if c not in _PLACE:
                raise ValueError(f"{c!r} is not in the key alphabet")
            out = out * _BASE + _PLACE[c]
        return out * _BASE ** (self.width - len(self.text))

    def moved(self, number: int) -> AlphanumKey:
        digits = []
        for _ in range(self.width):
            number, d = divmod(number, _BASE)
            digits.append(d)
        digits.reverse()
        text = ""
        for d in digits:
            if d == 0:
                break
            text += ALPHABET[d - 1]
        return AlphanumKey(text, self.width)

    def __str__(self):
        return self.text


@dataclass(frozen=True)
class Vector:
    """Values of a compound key in product order: less when every part is less."""

    parts: tuple

    def __lt__(self, other: Vector) -> bool:
        return all(a < b for a, b in zip(self.parts, other.parts))

    def __le__(self, other: Vector) -> bool:
        return all(a <= b for a, b in zip(self.parts, other.parts))

    def __sub__(self, other: Vector) -> Vector:
        return Vector(tuple(a - b for a, b in zip(self.parts, other.parts)))

    def __add__(self, n: int) -> Vector:
        return Vector(tuple(a + n for a in self.parts))

    def __iter__(self):
        return iter(self.parts)

    def __len__(self):
        return len(self.parts)


def split_space(start: int, end: int, count: int) -> list[int]:
    """``count`` points between, evenly spaced."""
    return [start + (end - start) * i // (count + 1) for i in range(1, count + 1)]


def split_keys(low: Any, high: Any, count: int) -> list:
    """low, points, high; fewer points where the space is small."""
    size = high - low
    if size <= count:
        count = 1
    if isinstance(low, ArithmeticKey):
        return [low, *(low + n for n in split_space(0, size, count)), high]
    return [low, *split_space(low, high, count), high]


def checkpoints(low: Vector, high: Vector, count: int) -> list[list]:
    """Points of every dimension, about ``count`` boxes in all."""
    per = max(1, int(count ** (1 / len(low))))
    return [split_keys(a, b, per) for a, b in zip(low, high)]


def mesh(points: Sequence[Sequence]) -> list[tuple[Vector, Vector]]:
    """All boxes (low, high) of the grid that the points make."""
    spans = [list(itertools.pairwise(p)) for p in points]
    return [(Vector(tuple(a for a, _ in box)), Vector(tuple(b for _, b in box))) for box in itertools.product(*spans)]


def outer_boxes(inner: tuple[Vector, Vector], outer: tuple[Vector, Vector]) -> list[tuple[Vector, Vector]]:
    """The boxes that ``outer`` has beside ``inner``: at most 3^k - 1 for k keys, none
    without extent."""
    points = [[min(a, low), low, high, max(b, high)] for a, low, high, b in zip(outer[0], *inner, outer[1])]
    return [box for box in mesh(points) if box != inner and all(a < b for a, b in zip(*box))]


def space_size(low: Vector, high: Vector) -> int:
    return math.prod(b - a for a, b in zip(low, high))


class LexicographicSpace:
    """Compound keys in dictionary order over dimensions of given sizes."""

    def __init__(self, dims: Sequence[int]):
        self.dims = tuple(dims)

    def number(self, key: Sequence[int]) -> int:
        return reduce(lambda acc, kd: acc * kd[1] + kd[0], zip(key, self.dims), 0)

    def key(self, number: int) -> tuple[int, ...]:
        out = []
        for d in reversed(self.dims):
            number, k = divmod(number, d)
            out.append(k)
        return tuple(reversed(out))

    def add(self, a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
        return self.key(self.number(a) + self.number(b))

    def sub(self, a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
        return self.key(self.number(a) - self.number(b))

    def divide(self, low: Sequence[int], high: Sequence[int], count: int) -> list[tuple[int, ...]]:
        return [self.key(n) for n in split_space(self.number(low), self.number(high), count)]


class BoundedLexicographicSpace(LexicographicSpace):
    """The same between two corners."""

    def __init__(self, low: Sequence[int], high: Sequence[int]):
        super().__init__([b - a for a, b in zip(low, high)])
        self.low = tuple(low)

    def divide(self, low: Sequence[int], high: Sequence[int], count: int) -> list[tuple[int, ...]]:
        down = lambda k: [x - a for x, a in zip(k, self.low)]
        return [tuple(x + a for x, a in zip(k, self.low)) for k in super().divide(down(low), down(high), count)]


def hash_bucket(keys: Sequence[Column], count: int) -> Column:
    """A bucket by the key texts, nulls told apart."""
    parts = [p for k in keys for p in (k.isNull(), k)]
    return F.pmod(F.xxhash64(*parts), F.lit(count))


def range_bucket(key: Column, points: Sequence) -> Column:
    """Number of the half-open range [points[i], points[i+1]) that holds the key."""
    out = F.lit(0)
    for p in points[1:-1]:
        out = out + (key >= F.lit(str(p) if isinstance(p, ArithmeticKey) else p)).cast("int")
    return out
