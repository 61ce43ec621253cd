"""Diff by recursive bisection of the key range.

Where tables lie sorted or partitioned by an integer key, ranges that agree need not
be read again: each level splits the ranges that disagree into ``factor`` equal ones
and sums both sides' row hashes over them in one job, whose filter on the key reaches
the scan. It ends when every range that disagrees has fewer rows than ``threshold``
(or is as short as the factor); their rows are compared as in ``hashdiff``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.functions import checksum as C
from veridelta.functions.normalize import json_text
from veridelta.sources.pushdown import RemoteTable

from .hashdiff import HashDiff, diff_sets
from .segment import Segment

#: Ranges that the driver follows; with more that disagree the search ends.
MAX_RANGES = 4096
#: Intervals that a filter on the key names; more are joined by closing the smallest gaps.
MAX_INTERVALS = 32


def merged(ranges: list[tuple[int, int]], most: int = MAX_INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` half-open intervals that cover the sorted ``ranges``."""
    out: list[list[int]] = []
    for low, high in ranges:
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])[: max(0, len(out) - most)]
    for i in sorted(gaps, reverse=True):
        out[i - 1][1] = out[i][1]
        del out[i]
    return [tuple(x) for x in out]


class RangeDiff(HashDiff):
    """``HashDiff`` that searches by ranges of the first key, an integer. Rows with a
    null first key are always compared. A side with a ``remote`` table has its sums
    computed there and only the rows of ranges that disagree read."""

    def __init__(self, a: Segment, b: Segment, remote: tuple[RemoteTable | None, RemoteTable | None] = (None, None), **options):
        super().__init__(a, b, **options)
        self.remote = dict(zip("ab", remote))
        self.factor = options.get("factor", 32)
        for s, key in ((self.a, self.a.keys[0]), (self.b, self.b.keys[0])):
            if s.schema[key].kind != "integer":
                raise NotImplementedError(f"ranges need an integer key: {key}")
        self.levels: list[dict] = []

    def _inside(self, s: Segment, intervals: list[tuple[int, int]] | None, tag: str = "") -> DataFrame:
        if tag and (remote := self.remote[tag]):
            return remote.run(remote.rows_sql(s.columns, s.keys[0], intervals, s.where))
        key = F.col(f"`{s.keys[0]}`")
        if intervals is None:
            return s.rows()
        tests = [key.isNull(), *((key >= low) & (key < high) for low, high in intervals)]
        return s.rows().filter(reduce(lambda x, y: x | y, tests))

    def _sums_of(self, tag: str, intervals, low: int, size: int) -> DataFrame:
        s = self.a if tag == "a" else self.b
        key, counted = s.keys[0], [(c, x) for c, x in zip(s.columns, self.names) if x not in self.ignored]
        if remote := self.remote[tag]:
            texts = [remote.text(c, s.schema[c]) for c, _ in counted]
            got = remote.run(remote.sums_sql(key, texts, low, size, intervals, s.where))
            return got.select(F.col("cell").cast("long").alias("cell"), F.col("n").alias(f"n_{tag}"), F.col("s").cast("decimal(38,0)").alias(f"s_{tag}"))
        texts = [json_text(s.text(c)) if x in self.json_columns else s.text(c) for c, x in counted]
        # Beside a database the hash is the one that it can compute.
        h = C.row_hash(texts) if any(self.remote.values()) else C.strong_hash(texts)
        cell = F.floor((F.col(f"`{key}`").cast("decimal(38,0)") - low) / size).cast("long")
        hashed = self._inside(s, intervals).filter(F.col(f"`{key}`").isNotNull()).select(cell.alias("cell"), h.cast("decimal(38,0)").alias("h"))
        return hashed.groupBy("cell").agg(F.count("*").alias(f"n_{tag}"), F.sum("h").alias(f"s_{tag}"))

    def _ends(self, tag: str) -> list[int]:
        s, remote = self.a if tag == "a" else self.b, self.remote[tag]
        key = s.keys[0]
        got = remote.run(remote.ends_sql(key, s.where)) if remote else s.rows().agg(F.min(f"`{key}`"), F.max(f"`{key}`"))
        return [int(v) for v in got.first() if v is not None]

    def search(self) -> list[tuple[int, int]]:
        """The ranges that disagree, in order."""
        found = self._ends("a") + self._ends("b")
        if not found:
            return []
        low, width = min(found), max(found) + 1 - min(found)
        depth = 1
        while self.factor**depth < width and depth < 12:
            depth += 1
        unit = -(-width // self.factor**depth)
        odd: list[tuple[int, int]] | None = None
        for level in range(1, depth + 1):
            size = unit * self.factor ** (depth - level)
            near = merged(odd) if odd is not None else None
            both = self._sums_of("a", near, low, size).join(self._sums_of("b", near, low, size), "cell", "full_outer")
            same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("s_a").eqNullSafe(F.col("s_b"))
            got = both.filter(~same).select("cell", F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("n")).limit(MAX_RANGES + 1).collect()
            if len(got) > MAX_RANGES and odd is not None:
                break
            odd = sorted((low + r["cell"] * size, low + (r["cell"] + 1) * size) for r in got)
            most = max((r["n"] for r in got), default=0)
            self.levels.append({"size": size, "ranges": len(odd), "max_rows": most})
            if len(got) > MAX_RANGES:
                return [(low, low + width)]
            if most < self.threshold or size < 2 * self.factor:
                break
        return odd or []

    def rows(self) -> DataFrame:
        near = merged(self.search())
        sides = []
        for tag, s in (("a", self.a), ("b", self.b)):
            kept = self._inside(s, near, tag)
            sides.append(kept.select(*(s.text(c).alias(x) for c, x in zip(s.columns, self.names))))
        return diff_sets(*sides, self.keys, self.ignored, self.json_columns)
