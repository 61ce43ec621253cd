"""Diff by one full outer join on the keys."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.normalize import as_text, comparable

from .align import check_keys, pairs
from .hashdiff import sign_column
from .segment import Segment


class JoinDiff:
    """Every output is planned over one join; call ``persist`` to share its run."""

    def __init__(self, a: Segment, b: Segment, skip_null_keys: bool = False, strict_keys: bool = False):
        check_keys(a, b, strict_keys)
        self.a, self.b, self.skip_null_keys = a, b, skip_null_keys
        self.pairs = pairs(a, b)
        self.names = [x for x, _ in self.pairs]
        self.key_names = list(a.keys)

    def _keyed(self, s: Segment) -> DataFrame:
        return s.rows().dropna(subset=list(s.keys)) if self.skip_null_keys else s.rows()

    def _side(self, s: Segment, tag: str) -> DataFrame:
        """Raw values by place; they become text only after the join."""
        return self._keyed(s).select(F.lit(1).alias(f"_{tag}"), *(comparable(F.col(f"`{c}`"), s.schema[c]).alias(f"_{tag}{i}") for i, c in enumerate(s.columns)))

    @cached_property
    def both(self) -> DataFrame:
        """xa, xb, and by place d (differs), a and b (the values as text)."""
        left, right = self._side(self.a, "a"), self._side(self.b, "b")
        on = reduce(lambda x, y: x & y, (F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(self.key_names))))
        joined = left.join(right, on, "full_outer")
        flags = [F.col("_b").isNull().cast("int").alias("xa"), F.col("_a").isNull().cast("int").alias("xb")]
        ignored = self.a.ignored | self.b.ignored
        values = []
        for i, (x, y) in enumerate(self.pairs):
            differs = F.lit(0) if x in ignored or y in ignored else (~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).cast("int")
            flags.append(differs.alias(f"d{i}"))
            values += [as_text(F.col(f"_{tag}{i}"), s.schema[c]).alias(f"{tag}{i}") for tag, s, c in (("a", self.a, x), ("b", self.b, y))]
        return joined.select(*flags, *values)

    def persist(self) -> JoinDiff:
        self.both = self.both.persist()
        return self

    def unpersist(self) -> None:
        self.both.unpersist()

    def _named(self, both: DataFrame) -> DataFrame:
        shown = {"xa": "is_exclusive_a", "xb": "is_exclusive_b"} | {f"d{i}": f"is_diff_{c}" for i, c in enumerate(self.names)}
        shown |= {f"{tag}{i}": f"{c}_{tag}" for i, c in enumerate(self.names) for tag in "ab"}
        if len({x.lower() for x in shown.values()}) < len(shown):
            raise ValueError(f"columns of these names have no wide form: {', '.join(self.names)}")
        return both.select(*(F.col(k).alias(v) for k, v in shown.items()))

    @property
    def joined(self) -> DataFrame:
        """is_exclusive_a, is_exclusive_b, is_diff_<c>..., <c>_a, <c>_b... for all keys."""
        return self._named(self.both)

    @property
    def different(self) -> DataFrame:
        flags = ["xa", "xb", *(f"d{i}" for i in range(len(self.names)))]
        return self.both.filter(reduce(lambda x, y: x | y, (F.col(f) == 1 for f in flags)))

    def wide(self, all_rows: bool = False) -> DataFrame:
        return self._named(self.both if all_rows else self.different)

    def rows(self) -> DataFrame:
        """The sign ('-' or '+', in ``sign_column``) and the columns as text; a changed
        row gives both."""
        cells = range(len(self.names))
        sides = [
            F.when(F.col(other) == 0, F.struct(F.lit(sign).alias("s"), *(F.col(f"{tag}{i}").alias(f"c{i}") for i in cells)))
            for sign, tag, other in (("-", "a", "xb"), ("+", "b", "xa"))
        ]
        found = self.different.select(F.explode(F.array_compact(F.array(*sides))).alias("r"))
        return found.select(F.col("r.s").alias(sign_column(self.names)), *(F.col(f"r.c{i}").alias(n) for i, n in enumerate(self.names)))

    def diff_counts(self) -> DataFrame:
        """One row: for each column the rows in which it differs."""
        counted = [(i, c) for i, c in enumerate(self.names) if c not in self.key_names]
        return self.different.agg(*(F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(c) for i, c in counted))

    def exclusive_count(self) -> DataFrame:
        return self.both.filter("xa = 1 or xb = 1").agg(F.count("*").alias("exclusive_count"))

    def sample_exclusive(self, n: int = 10, seed: int | None = None) -> DataFrame:
        return self._named(self.both.filter("xa = 1 or xb = 1").orderBy(F.rand(seed)).limit(n))

    def table_stats(self) -> DataFrame:
        """table, count, and the sum of every numeric column that is no key."""
        out = []
        for name, s in (("a", self.a), ("b", self.b)):
            sums = []
            for c, shown in zip(s.columns, self.names):
                t = s.schema[c]
                if c not in s.keys and t.fractional:
                    sums.append(F.sum(F.col(f"`{c}`").cast(f"decimal(38,{t.precision})")).cast("string").alias(f"sum_{shown}"))
            out.append(s.rows().agg(F.count("*").alias("count"), *sums).select(F.lit(name).alias("table"), "*"))
        return out[0].unionByName(out[1], allowMissingColumns=True)

    def duplicate_keys(self, side: str = "a") -> DataFrame:
        s = self.a if side == "a" else self.b
        return self._keyed(s).groupBy(*(F.col(f"`{k}`") for k in s.keys)).agg(F.count("*").alias("n")).filter("n > 1")

    def null_keys(self, side: str = "a") -> DataFrame:
        s = self.a if side == "a" else self.b
        return s.rows().filter(reduce(lambda x, y: x | y, (F.col(f"`{k}`").isNull() for k in s.keys)))

    def validate(self) -> dict:
        """Raise if a key repeats (unless declared unique) or, unless skipped, is null."""
        checked = []
        for side, s in (("a", self.a), ("b", self.b)):
            if not set(s.keys) <= s.unique:
                if not self.duplicate_keys(side).isEmpty():
                    raise ValueError(f"duplicate keys in table {side}")
                checked += list(s.keys)
            if not self.skip_null_keys and not self.null_keys(side).isEmpty():
                raise ValueError(f"null keys in table {side}")
        return {"validated_unique_keys": checked}
