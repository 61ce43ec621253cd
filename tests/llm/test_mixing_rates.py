"""Mixing at rates beyond one draw."""

import math

import pytest

from veridelta.llm import mixing


def test_rates_over_one_draw(spark):
    """By default weights one short document beside much text, and a greater rate by given weights."""
    rows = [(i, "w" * 1000, "hot") for i in range(900)] + [(9000 + i, "w" * (i + 1), s) for i, s in enumerate(("rare", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"hot": 0.9, "rare": 0.05, None: 0.05}):
        rate = {r["source"]: r["rate"] for r in mixing.rates(docs, weights).collect()}
        got = {r["source"]: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
        assert set(got) == {"hot", "rare", None} and rate["rare"] > 700
        for source in ("rare", None):
            assert abs(got[source] - rate[source]) < 6 * math.sqrt(rate[source])
    assert sorted(map(tuple, mixing.mix(docs).groupBy("doc_id").count().collect())) == sorted(map(tuple, mixing.mix(docs.repartition(3)).groupBy("doc_id").count().collect()))


def test_columns_that_are_needed(spark):
    with pytest.raises(ValueError, match="source, text"):
        mixing.mix(spark.createDataFrame([(1, "x")], "doc_id long, body string"))
