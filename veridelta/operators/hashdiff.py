"""Diff by bucket checksums: only rows of buckets that disagree are compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import checksum as C
from veridelta.functions.keyspace import hash_bucket, range_bucket, split_keys
from veridelta.functions.normalize import json_text

from .align import check_keys, pairs, reduced
from .segment import Segment

DEFAULT_FACTOR, DEFAULT_THRESHOLD = 32, 16_384
MAX_BUCKETS = 1_000_000


def check_options(factor: int, threshold: int) -> None:
    if factor < 2:
        raise ValueError("the bisection factor must be 2 or more")
    if factor >= threshold:
        raise ValueError("the bisection factor must be below the threshold")


def sign_column(names: list[str]) -> str:
    """Name of the sign column: ``op``, with as many ``_`` as it takes to differ from
    the compared columns."""
    taken, name = {n.lower() for n in names}, "op"
    while name in taken:
        name += "_"
    return name


def diff_sets(a: DataFrame, b: DataFrame, keys: list[str], ignored: frozenset[str] = frozenset(), json_columns: frozenset[str] = frozenset()) -> DataFrame:
    """All rows, ``-`` of a and ``+`` of b, of every key except those with exactly one
    row on each side that agree in all columns that count.

    Keys group null-safely. The keys that differ are found by an aggregation that
    combines before the shuffle, and their rows by a semi join, so a key with very
    many rows stays spread. Inside, columns go by place, so any name may be compared;
    the sign is in ``sign_column``."""
    names = a.columns
    cells = [f"c{i}" for i in range(len(names))]
    place = dict(zip(names, cells))
    sides = (x.select(*(F.col(f"`{n}`").alias(c) for n, c in place.items())).withColumn("sign", F.lit(sign)) for x, sign in ((a, "-"), (b, "+")))
    both = reduce(DataFrame.unionByName, sides)
    counted = [json_text(F.col(place[c])) if c in json_columns else F.col(place[c]) for c in names if c not in ignored and c not in keys]
    value = F.struct(*counted) if counted else F.struct(F.lit(0))
    same = (F.col("na") == 1) & (F.col("nb") == 1) & F.col("low").eqNullSafe(F.col("high"))
    found = (
        both.groupBy(*(F.col(place[k]).alias(f"k{i}") for i, k in enumerate(keys)))
        .agg(F.count_if(F.col("sign") == "-").alias("na"), F.count_if(F.col("sign") == "+").alias("nb"), F.min(value).alias("low"), F.max(value).alias("high"))
        .filter(~same)
        .select(*(f"k{i}" for i in range(len(keys))))
    )
    on = reduce(lambda x, y: x & y, (F.col(place[k]).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)))
    return both.join(found, on, "left_semi").select(F.col("sign").alias(sign_column(names)), *(F.col(c).alias(n) for n, c in place.items()))


def estimated_rows(df: DataFrame) -> int:
    """Rows by the optimizer's estimate of the bytes; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, size // max(1, df._jdf.schema().defaultSize()))


class HashDiff:
    def __init__(
        self,
        a: Segment,
        b: Segment,
        buckets: int | None = None,
        factor: int = DEFAULT_FACTOR,
        threshold: int = DEFAULT_THRESHOLD,
        strict_keys: bool = False,
        json_columns: frozenset[str] = frozenset(),
    ):
        check_options(factor, threshold)
        if strict_keys:
            a, b = a.with_types(), b.with_types()
        check_keys(a, b, strict_keys)
        self.a, self.b = reduced(a, b)
        self.pairs = pairs(a, b)
        self.names = [x for x, _ in self.pairs]
        self.keys = list(a.keys)
        self.json_columns = json_columns | {x for x, _ in self.pairs if self.a.schema[x].kind == "json"}
        self.ignored = frozenset(x for x, y in self.pairs if x in a.ignored or y in b.ignored)
        self.threshold, self._buckets = threshold, buckets

    @property
    def buckets(self) -> int:
        """About ``threshold`` rows in each by estimate; bounded, so their list can be
        broadcast. Their number changes the cost, never the result."""
        if self._buckets is None:
            rows = max(estimated_rows(self.a.rows()), estimated_rows(self.b.rows()))
            self._buckets = max(1, min(MAX_BUCKETS, -(-rows // self.threshold) * 4))
        return self._buckets

    def texts(self, side: Segment) -> DataFrame:
        """The side's columns as canonical text, by place: c0, c1..."""
        return side.rows().select(*(side.text(c).alias(f"c{i}") for i, c in enumerate(side.columns)))

    def _bucket(self) -> Column:
        return hash_bucket([F.col(f"c{self.names.index(k)}") for k in self.keys], self.buckets).alias("bucket")

    def _sums(self, side: Segment, tag: str) -> DataFrame:
        texts = [json_text(F.col(f"c{i}")) if c in self.json_columns else F.col(f"c{i}") for i, c in enumerate(self.names) if c not in self.ignored]
        hashed = self.texts(side).select(self._bucket(), C.strong_hash(texts).cast("decimal(38,0)").alias("h"))
        return hashed.groupBy("bucket").agg(F.count("*").alias(f"count_{tag}"), F.sum("h").alias(f"checksum_{tag}"))

    def summary(self) -> DataFrame:
        """bucket, count_a, count_b, checksum_a, checksum_b, is_diff."""
        both = self._sums(self.a, "a").join(self._sums(self.b, "b"), "bucket", "full_outer")
        same = F.col("count_a").eqNullSafe(F.col("count_b")) & F.col("checksum_a").eqNullSafe(F.col("checksum_b"))
        return both.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("count_a", "count_b")), "checksum_a", "checksum_b", (~same).alias("is_diff"))

    def rows(self) -> DataFrame:
        """The sign (``sign_column``) and the columns as text under the first side's names."""
        odd = self.summary().filter("is_diff").select("bucket")
        odd = F.broadcast(odd) if self.buckets <= MAX_BUCKETS else odd
        sides = []
        for s in (self.a, self.b):
            kept = self.texts(s).withColumn("bucket", self._bucket()).join(odd, "bucket", "left_semi")
            sides.append(kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(self.names))))
        return diff_sets(*sides, self.keys, self.ignored, self.json_columns)

    def info(self) -> dict:
        """Totals over the buckets: rows of both sides, buckets that differ, and the
        most rows that had to be compared."""
        got = self.summary().agg(
            F.sum("count_a").alias("rows_a"),
            F.sum("count_b").alias("rows_b"),
            F.count_if(F.col("is_diff")).alias("buckets_compared"),
            F.sum(F.when(F.col("is_diff"), F.greatest("count_a", "count_b"))).alias("rows_compared"),
        )
        return {k: int(v or 0) for k, v in got.first().asDict().items()}


def range_checksums(s: Segment, buckets: int = DEFAULT_FACTOR) -> DataFrame:
    """Count and checksum (a decimal, so that it can't overflow) of each even range of
    the first key: segment_id, n, checksum."""
    low, high = s.key_range()
    points = split_keys(low.parts[0], high.parts[0] + 1, max(1, buckets - 1))
    bucket = range_bucket(F.col(f"`{s.keys[0]}`"), points).alias("segment_id")
    texts = [s.text(c) for c in s.checked()]
    return s.rows().groupBy(bucket).agg(F.count("*").alias("n"), C.checksum(texts).alias("checksum"))
