"""Connected components by randomised contraction, without the driver.

In each round every node adopts the neighbour (or itself) of the least hash,
the edges are rewritten to the adopted nodes and shrink by a constant factor
on average whatever the graph's shape; the rounds' maps are then composed. As soon
as few edges are left, one task joins them: a round costs several jobs whatever its
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that one task may hold (16 bytes each, and some lists).
FEW = 300_000


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for x, y in zip(*np.split(at, 2)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return nodes, nodes[[root(i) for i in range(len(nodes))]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if got:
            nodes, to = _joined(*map(np.concatenate, zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(to)], ["node", "to"])

    return checkpoint(edges.coalesce(1).mapInArrow(run, "node long, to long"))


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long); nodes of one
    component, and only they, have one root."""
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while left_over := edges.count():
        if left_over <= few:
            maps.append(_in_one_task(edges))
            break
        rank = F.xxhash64(F.lit(len(maps)), F.col("b"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank.alias("h"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(len(maps)), F.col("a")).alias("h"), F.col("a").alias("b"))
        step = checkpoint(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("to")))
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = checkpoint(
            edges.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct()
        )
        maps.append(step)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        step = step.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
        roots = roots.join(step, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    return checkpoint(roots)
