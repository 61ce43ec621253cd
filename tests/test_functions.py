"""Normalisation, hashes, key arithmetic and ages."""

import hashlib
import itertools
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridelta.errors import AgeError
from veridelta.functions import keyspace as K
from veridelta.functions.ages import age
from veridelta.functions.checksum import joined_text, md5_as_hex, md5_as_int
from veridelta.functions.logical import logical_schema, logical_type, refined
from veridelta.functions.normalize import json_text, normalize, number_text, time_text, timestamp_text
from veridelta.operators.result import number_to_human


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_md5(spark):
    assert one(spark, md5_as_int(F.lit("hello world"))) == -102548529033788
    assert one(spark, md5_as_hex(F.lit("hello world"))) == hashlib.md5(b"hello world").hexdigest()


def test_joined_text(spark):
    null = F.lit(None).cast("string")
    assert one(spark, joined_text([F.lit("a"), null])) == "a|<null>"
    assert one(spark, joined_text([null])) is None


@pytest.mark.parametrize(
    "value, kind, want",
    [
        (127, "int", "127"),
        (-9, "long", "-9"),
        (True, "boolean", "1"),
        (1 / 3, "double", "0.3333333333333"),
        (100.98, "double", "100.9800000000000"),
        (float("nan"), "double", "NaN"),
        (float("inf"), "double", "Infinity"),
        (1e30, "double", "1.0E30"),
        (0.5, "float", "0.50000"),
        (Decimal("1.50"), "decimal(10,2)", "1.50"),
        (date(2022, 1, 2), "date", "2022-01-02"),
        (datetime(2022, 1, 1, 15, 10, 3, 5), "timestamp", "2022-01-01 15:10:03.000005"),
        (datetime(9999, 12, 31, 23, 59, 59, 999999), "timestamp_ntz", "9999-12-31 23:59:59.999999"),
        ([1, None], "array<int>", "[1,null]"),
        ("as it is ", "string", "as it is "),
    ],
)
def test_canonical_text(spark, value, kind, want):
    df = spark.createDataFrame([(value,), (None,)], f"x {kind}")
    t = logical_schema(df)["x"]
    got = [r[0] for r in df.select(normalize(F.col("x"), t)).collect()]
    assert got == [want, None]


@pytest.mark.parametrize("rounds, want", [(True, "2022-01-01 15:10:03.124000"), (False, "2022-01-01 15:10:03.123000")])
def test_timestamp_digits(spark, rounds, want):
    ts = F.lit("2022-01-01 15:10:03.123500").cast("timestamp")
    assert one(spark, timestamp_text(ts, 3, rounds)) == want


def test_time_and_numbers(spark):
    assert one(spark, time_text(F.lit("15:10:03.5"))) == "15:10:03.500000"
    assert one(spark, number_text(F.lit(Decimal("12.345")), 1)) == "12.3"


def test_json(spark):
    assert one(spark, json_text(F.lit('{"b": 2, "a": 1.0}'))) == '{"a":1,"b":2}'
    assert one(spark, json_text(F.lit("{broken"))) == "{broken"


def test_refined_types(spark):
    rows = [("7B2AE7B0-0000-0000-0000-000000000001", "a-1", "no key"), (None, None, None)]
    df = spark.createDataFrame(rows, "u string, a string, t string")
    got = refined(df, logical_schema(df), df.columns)
    assert [got[c].kind for c in df.columns] == ["uuid", "alphanum", "text"] and got["u"].upper


def test_logical_precision():
    from pyspark.sql import types as T

    assert logical_type(T.FloatType()).precision == 5 and logical_type(T.DoubleType()).precision == 13


def test_split_space_exhaustive():
    for start, size in itertools.product(range(0, 40, 7), range(1, 60)):
        for count in range(1, size):
            got = K.split_space(start, start + size, count)
            assert len(got) == count and got == sorted(got) and start <= got[0] and got[-1] < start + size


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**128 - 1), st.integers(0, 2**128 - 1), st.integers(2, 40))
def test_uuid_keys_split_evenly(a, b, count):
    low, high = sorted((a, b))
    if high - low <= count:
        return
    import uuid

    points = K.split_keys(K.UuidKey.of(str(uuid.UUID(int=low))), K.UuidKey.of(str(uuid.UUID(int=high))), count)
    steps = [y - x for x, y in itertools.pairwise(points)]
    assert max(steps) - min(steps) <= 1 and len(points) == count + 2
    assert K.UuidKey.of("7B2AE7B0-0000-0000-0000-00000000000A").upper


@settings(max_examples=100, deadline=None)
@given(st.text(K.ALPHABET, min_size=1, max_size=12), st.text(K.ALPHABET, min_size=1, max_size=12))
def test_alphanumeric_keys_keep_byte_order(a, b):
    x, y = K.AlphanumKey.pair(a, b)
    assert (x < y) == (a < b) and str(x.moved(x.number())) == a


def test_alphanumeric_rejects():
    with pytest.raises(ValueError):
        K.AlphanumKey("a@b", 3).number()


def test_mesh_covers_the_space():
    boxes = K.mesh([[0, 3, 9], [0, 5, 10]])
    assert len(boxes) == 4
    for p in itertools.product(range(9), range(10)):
        assert sum(all(a <= x < b for a, x, b in zip(low, p, high)) for low, high in boxes) == 1
    assert K.space_size(K.Vector((0, 0)), K.Vector((9, 10))) == 90


def test_vectors():
    assert K.Vector((1, 2)) < K.Vector((2, 3)) and not K.Vector((1, 3)) < K.Vector((2, 3))
    assert tuple(K.Vector((5, 7)) - K.Vector((1, 2))) == (4, 5)


def test_lexicographic_space():
    space = K.LexicographicSpace([10, 5, 7])
    rng = random.Random(1)
    for _ in range(200):
        k = tuple(rng.randrange(d) for d in space.dims)
        assert space.key(space.number(k)) == k
    a, b = (1, 2, 3), (4, 4, 6)
    assert space.sub(space.add(a, (0, 0, 5)), (0, 0, 5)) == a
    points = [a, *space.divide(a, b, 9), b]
    steps = [space.number(y) - space.number(x) for x, y in itertools.pairwise(points)]
    assert max(steps) - min(steps) <= 1
    bounded = K.BoundedLexicographicSpace((5, 5), (10, 9))
    assert all(5 <= x < 10 and 5 <= y < 9 for x, y in bounded.divide((5, 5), (9, 8), 6))


def test_hash_bucket_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    got = {r[0] for r in df.select(K.hash_bucket([F.col("x"), F.col("y")], 1 << 30)).collect()}
    assert len(got) == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("5min", timedelta(minutes=5)),
        ("1w2d3h4min5s", timedelta(weeks=1, days=2, hours=3, minutes=4, seconds=5)),
        ("2mon", timedelta(days=60)),
        ("1y", timedelta(days=365)),
        ("1 day 2 hours", timedelta(days=1, hours=2)),
    ],
)
def test_ages(text, want):
    assert age(text) == want


@pytest.mark.parametrize("text", ["", "5", "min", "5min5min", "3parsecs", "1d!"])
def test_bad_ages(text):
    with pytest.raises(AgeError):
        age(text)


def test_age_suggestion():
    with pytest.raises(AgeError, match="minute"):
        age("3minuts")


def test_human_numbers():
    assert [number_to_human(n) for n in (5, 1200, 3_400_000, 2_000_000_000)] == ["5", "1k", "3m", "2b"]
