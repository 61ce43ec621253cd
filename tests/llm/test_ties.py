"""Ties, repeated rows and hot keys of the dedup operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridelta.llm import common, exact_dedup, jaccard, simhash

SCHEMA = "doc_id long, text string, source string, kept string"
LONG = " ".join(f"word{i}" for i in range(60))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_keep_one_has_a_total_order(spark):
    """Rows of one id whose texts differ by case, or which differ elsewhere."""
    rows = [(7, "A b", "x", "1"), (7, "a B", "y", "2"), (7, "a b", None, "3"), (5, "a b", "z", "4"), (None, "other", "x", None), (None, "OTHER", "x", None)]
    seen = {tuple(rows_of(exact_dedup.keep_one(spark.createDataFrame(rows[i:] + rows[:i], SCHEMA).repartition(3)))) for i in range(4)}
    assert len(seen) == 1
    (got,) = seen
    assert len(got) == 2 and {r[0] for r in got} == {7, None} and all(r in rows for r in got)


@pytest.mark.parametrize("keep_one", [simhash.keep_one, jaccard.keep_one])
def test_near_keep_one_leaves_one_of_repeated_rows(spark, keep_one):
    rows = [(3, LONG, "x", None)] * 4 + [(3, LONG, "y", None), (8, LONG.upper(), "x", None), (9, "a quite different text " * 9, "x", None), (None, "", None, None)]
    got = rows_of(keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert sorted((r[0] or 0 for r in got)) == [0, 3, 9] and all(r in rows for r in got)
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spread_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    left = spark.createDataFrame([(i, f"k{0 if i % 3 else i % 40}") for i in range(400)] + [(None, "k0"), (1, "alone")], "doc_id long, k string")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).filter("k <> 'alone'")
    got = common.spread_join(left, right, "k", "n", 402, "doc_id")
    want = left.join(right, "k", "left").select("doc_id", "k", "low")
    assert got.columns == ["doc_id", "k", "low"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_without_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}", "s", None) for i in range(50)] + [(None, "x", None, None)], SCHEMA)
    losers = docs.filter("doc_id % 3 = 0 or doc_id is null").select("doc_id", F.col("text").alias("t"))
    keys = {"doc_id": F.col("doc_id"), "t": F.col("text")}
    few = common.without(docs, losers, keys)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    many = common.without(docs, losers, keys)
    assert rows_of(few) == rows_of(many) and few.count() == 33
    assert "Broadcast" not in many._jdf.queryExecution().optimizedPlan().toString().split("rightHint")[-1][:20]
