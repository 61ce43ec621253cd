"""Join and checksum diffs on small tables, and against a plain Python comparison."""

import json
import random
import uuid
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veridelta import HashDiff, JoinDiff, Segment, diff_tables
from veridelta.errors import KeyTypesDiffer
from veridelta.functions.keyspace import Vector
from veridelta.operators.hashdiff import range_checksums
from veridelta.operators.result import json_error, json_report
from veridelta.operators.schema_diff import expand, schema_diff


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def text(v):
    return None if v is None else str(v)


def plain_diff(a, b, keys):
    """All rows of every key but those with one equal row on each side."""
    sides = defaultdict(lambda: ([], []))
    for i, rows in enumerate((a, b)):
        for r in rows:
            sides[tuple(r[:keys])][i].append(tuple(map(text, r)))
    out = Counter()
    for x, y in sides.values():
        if not (len(x) == len(y) == 1 and x == y):
            out.update(("-", *r) for r in x)
            out.update(("+", *r) for r in y)
    return out


RATINGS = "id long, movie long, rating double, at timestamp"
T = datetime(2022, 1, 1)


def test_equal_tables_have_no_rows(spark):
    a = frame(spark, [(1, 1, 9.0, T), (2, 2, 9.0, T)], RATINGS)
    for algorithm in ("joindiff", "hashdiff"):
        got = diff_tables(a, a, key_columns=("id",), extra_columns=("movie", "rating", "at"), algorithm=algorithm)
        assert list(got) == []
        assert got.stats["unchanged"] == 2 and got.stats["stats"]["diff_percent"] == 0


def test_values_come_out_as_text(spark):
    a = frame(spark, [(1, 1, 9.0, T)], RATINGS)
    b = frame(spark, [(2, 1, 9.0, T)], RATINGS)
    want = Counter([("-", "1", "9.0000000000000", "2022-01-01 00:00:00.000000"), ("+", "2", "9.0000000000000", "2022-01-01 00:00:00.000000")])
    for algorithm in ("joindiff", "hashdiff"):
        got = diff_tables(a, b, key_columns=("id",), extra_columns=("rating", "at"), algorithm=algorithm)
        assert bag(got.df) == want


def test_stats(spark):
    a = frame(spark, [(i, i * 10) for i in range(10)], "id long, v long")
    b = frame(spark, [(i, i * 10 + (i == 3)) for i in range(1, 12)], "id long, v long")
    got = diff_tables(a, b, extra_columns=("v",))
    s = got.stats
    assert (s["rows_A"], s["rows_B"], s["exclusive_A"], s["exclusive_B"], s["updated"], s["unchanged"]) == (10, 11, 1, 2, 1, 8)
    assert got.text_stats().splitlines()[4] == "1 rows updated"
    assert {json.loads(r["value"])[0] for r in got.json_lines().collect()} == {"-", "+"}
    assert got.sources.diff_counts().first()["v"] == 4
    assert got.sources.exclusive_count().first()[0] == 3


def test_empty_tables(spark):
    a = frame(spark, [(1, "x")], "id long, v string")
    none = a.limit(0)
    for algorithm in ("joindiff", "hashdiff"):
        assert bag(diff_tables(a, none, extra_columns=("v",), algorithm=algorithm).df) == Counter([("-", "1", "x")])
        empty = diff_tables(none, none, extra_columns=("v",), algorithm=algorithm)
        assert empty.stats["total"] == 0 and empty.stats["stats"]["diff_percent"] == 0
    assert Segment(none, extras=("v",)).count_and_checksum() == (0, None)
    with pytest.raises(ValueError):
        Segment(none).key_range()


def test_checksum_of_one_row(spark):
    import hashlib

    df = frame(spark, [(1, datetime(2022, 1, 1))], "id long, at timestamp")
    want = int(hashlib.md5(b"1|2022-01-01 00:00:00.000000").hexdigest()[20:], 16) - 140737488355327
    assert Segment(df, extras=("at",)).count_and_checksum() == (1, want)


def test_nulls_count_in_checksums(spark):
    a = frame(spark, [(1, None, "x"), (2, "y", None)], "id long, c1 string, c2 string")
    b = frame(spark, [(1, "x", None), (2, None, "y")], "id long, c1 string, c2 string")
    got = diff_tables(a, b, extra_columns=("c1", "c2"), algorithm="hashdiff")
    assert sum(bag(got.df).values()) == 4


def test_duplicate_keys(spark):
    a = frame(spark, [(1, "a"), (1, "b")], "id long, v string")
    b = frame(spark, [(1, "a"), (1, "a"), (2, "c"), (2, "c")], "id long, v string")
    got = bag(diff_tables(a, b, extra_columns=("v",), algorithm="hashdiff").df)
    assert got == Counter({("-", "1", "a"): 1, ("-", "1", "b"): 1, ("+", "1", "a"): 2, ("+", "2", "c"): 2})
    with pytest.raises(ValueError, match="duplicate"):
        diff_tables(a, b, extra_columns=("v",), algorithm="joindiff")
    assert len(list(diff_tables(a, b, extra_columns=("v",), algorithm="joindiff", validate_unique_key=False))) > 0


def test_null_keys(spark):
    a = frame(spark, [(1, "a"), (None, "b")], "id long, v string")
    b = frame(spark, [(1, "a")], "id long, v string")
    with pytest.raises(ValueError, match="null"):
        diff_tables(a, b, extra_columns=("v",), algorithm="joindiff")
    assert list(diff_tables(a, b, extra_columns=("v",), algorithm="joindiff", skip_null_keys=True)) == []
    assert bag(diff_tables(a, b, extra_columns=("v",), algorithm="hashdiff").df) == Counter([("-", None, "b")])


def test_renamed_columns_pair_by_position(spark):
    a = frame(spark, [(1, 2), (2, 3)], "id long, v long")
    b = frame(spark, [(1, 2), (2, 4)], "id2 long, v2 long")
    for algorithm in ("joindiff", "hashdiff"):
        got = diff_tables(Segment(a, ("id",), extras=("v",)), Segment(b, ("id2",), extras=("v2",)), algorithm=algorithm)
        assert bag(got.df) == Counter([("-", "2", "3"), ("+", "2", "4")])
        assert got.df.columns == ["op", "id", "v"]


def test_ignored_column(spark):
    a = frame(spark, [(1, 2, 5), (2, 3, 5)], "id long, v long, w long")
    b = frame(spark, [(1, 9, 5), (2, 3, 6)], "id long, v long, w long")
    sides = [Segment(x, extras=("v", "w"), ignored=frozenset(["v"])) for x in (a, b)]
    for differ in (HashDiff(*sides), JoinDiff(*sides)):
        assert {r["id"] for r in differ.rows().collect()} == {"2"}


def test_bounds_and_windows(spark):
    a = frame(spark, [(i, datetime(2022, 1, 1 + i)) for i in range(10)], "id long, at timestamp")
    b = a.limit(0)
    got = diff_tables(a, b, update_column="at", min_key=2, max_key=8, min_update=datetime(2022, 1, 5), where="id <> 6")
    assert {r["id"] for r in got.df.collect()} == {"4", "5", "7"}
    with pytest.raises(ValueError):
        Segment(a, min_update=T)
    with pytest.raises(ValueError):
        Segment(a, min_key=Vector((3,)), max_key=Vector((3,)))
    plan = Segment(spark.read.parquet(written(a, spark)), min_key=Vector((2,))).rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan


def written(df, spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def test_columns_by_case(spark):
    a = frame(spark, [(1, 2)], "Id long, V long")
    with pytest.raises(ValueError):
        Segment(a, ("id",))
    assert Segment(a, ("id",), extras=("v",), case_sensitive=False).columns == ["Id", "V"]


def test_compound_and_mixed_keys(spark):
    rows = [(str(uuid.UUID(int=i)), i % 7, f"t{i}") for i in range(100)]
    other = [(k, n + (i == 50), t) for i, (k, n, t) in enumerate(rows)]
    a, b = (frame(spark, r, "id string, id2 int, v string") for r in (rows, other))
    for algorithm in ("joindiff", "hashdiff"):
        got = bag(diff_tables(a, b, key_columns=("id", "id2"), extra_columns=("v",), algorithm=algorithm).df)
        assert got == plain_diff(rows, other, 2)
    with pytest.raises(ValueError):
        JoinDiff(Segment(a, ("id",)), Segment(b, ("id", "id2")))


def test_key_types(spark):
    a, b = frame(spark, [(1,)], "id long"), frame(spark, [("1",)], "id string")
    with pytest.raises(KeyTypesDiffer):
        diff_tables(a, b, algorithm="hashdiff")
    texts = frame(spark, [("a b",)], "id string")
    with pytest.raises(NotImplementedError):
        HashDiff(Segment(texts), Segment(texts), strict_keys=True)
    assert list(diff_tables(texts, texts, algorithm="hashdiff")) == []


def test_precision_is_mutual(spark):
    a = frame(spark, [(1, 1.4)], "id long, v double").select("id", F.col("v").cast("decimal(10,1)").alias("v"))
    b = frame(spark, [(1, 1)], "id long, v long")
    assert list(diff_tables(a, b, extra_columns=("v",), algorithm="hashdiff")) == []
    with pytest.raises(TypeError):
        diff_tables(frame(spark, [(1, T)], "id long, v timestamp"), b, extra_columns=("v",), algorithm="hashdiff")


def test_json_columns(spark):
    a = frame(spark, [(1, '{"a": 1, "b": 2}'), (2, "[1]"), (3, "no json")], "id long, j string")
    b = frame(spark, [(1, '{"b":2,"a":1}'), (2, "[2]"), (3, "no json")], "id long, j string")
    sides = [Segment(x, extras=("j",)) for x in (a, b)]
    got = HashDiff(*sides, json_columns=frozenset(["j"])).rows()
    assert {r["id"] for r in got.collect()} == {"2"}


def test_options_are_checked(spark):
    a = frame(spark, [(1,)], "id long")
    for factor, threshold in ((1, 100), (100, 50)):
        with pytest.raises(ValueError):
            diff_tables(a, a, algorithm="hashdiff", bisection_factor=factor, bisection_threshold=threshold)
    with pytest.raises(ValueError):
        diff_tables(a, a, algorithm="other")


@pytest.mark.parametrize("seed", range(4))
def test_random_perturbations(spark, seed):
    """Both algorithms, any number of buckets, and plain Python agree; signs swap with the sides."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "x", "y|z", ""]), rng.choice([None, 1, 2])) for i in range(300)]
    other = []
    for r in rows:
        if rng.random() < 0.05:
            continue
        other.append((r[0], rng.choice([r[1], "q"]) if rng.random() < 0.1 else r[1], r[2]))
    other += [(1000 + i, "new", None) for i in range(rng.randint(0, 5))]
    schema = "id long, s string, n int"
    a, b = frame(spark, rows, schema), frame(spark, other, schema)
    want = plain_diff(rows, other, 1)
    sides = Segment(a, extras=("s", "n")), Segment(b, extras=("s", "n"))
    assert bag(JoinDiff(*sides).rows()) == want
    for buckets in (1, 7, 64):
        assert bag(HashDiff(*sides, buckets=buckets).rows()) == want
    swap = {"-": "+", "+": "-"}
    assert bag(HashDiff(*sides[::-1]).rows()) == Counter({(swap[k[0]], *k[1:]): n for k, n in want.items()})
    only_a, only_b = bag(a.exceptAll(b)), bag(b.exceptAll(a))
    assert sum(only_a.values()) == sum(n for k, n in want.items() if k[0] == "-")
    assert sum(only_b.values()) == sum(n for k, n in want.items() if k[0] == "+")


def test_random_duplicates(spark):
    rng = random.Random(9)
    make = lambda: [(rng.randint(0, 20), rng.choice("ab")) for _ in range(60)]
    rows, other = make(), make()
    a, b = (frame(spark, r, "id long, v string") for r in (rows, other))
    assert bag(HashDiff(Segment(a, extras=("v",)), Segment(b, extras=("v",)), buckets=5).rows()) == plain_diff(rows, other, 1)


def test_only_odd_buckets_are_compared(spark):
    a = spark.range(5000).select(F.col("id"), (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    info = HashDiff(Segment(a, extras=("v",)), Segment(b, extras=("v",)), buckets=100).info()
    assert info["buckets_compared"] == 1 and info["rows_compared"] < 200
    same = HashDiff(Segment(a, extras=("v",)), Segment(a, extras=("v",)), buckets=100).info()
    assert same["rows_compared"] == 0


def test_range_checksums_cover_all_rows(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("v"))
    s = Segment(df, extras=("v",))
    got = range_checksums(s, 8).collect()
    n, total = s.count_and_checksum()
    assert sum(r["n"] for r in got) == n and sum(r["checksum"] for r in got) == total


def test_wide_table(spark):
    names = [f"c{i}" for i in range(100)]
    a = spark.range(11).select("id", *(F.lit("t").alias(c) for c in names))
    b = a.filter("id < 10")
    got = diff_tables(a, b, extra_columns=tuple(names), algorithm="hashdiff")
    assert [op for op, _ in got] == ["-"]


def test_materialised_and_sampled(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "id long, v string")
    b = frame(spark, [(1, "x")], "id long, v string")
    got = diff_tables(a, b, extra_columns=("v",), materialize_to_table="found_rows", sample_exclusive_rows=True)
    row = spark.table("found_rows").collect()
    assert [tuple(r) for r in row] == [(1, 0, 1, 1, "2", None, "y", None)]
    assert got.extra["exclusive_count"] == 1 and len(got.extra["exclusive_sample"]) == 1
    diff_tables(a, b, extra_columns=("v",), materialize_to_table="found_rows", materialize_all_rows=True)
    assert spark.table("found_rows").count() == 2
    spark.sql("DROP TABLE found_rows")


def test_json_report(spark):
    a = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "id long, v string")
    b = frame(spark, [(1, "x"), (2, "q"), (4, "z")], "id long, v string")
    got = diff_tables(a, b, extra_columns=("v",))
    report = json_report(got.sources, got, ("a", "b"))
    assert report["version"] == "1.1.0" and report["result"] == "different"
    assert report["rows"]["exclusive"] == {"dataset1": [{"id": {"isPK": True, "value": "3"}, "v": {"isPK": False, "value": "z"}}], "dataset2": [{"id": {"isPK": True, "value": "4"}, "v": {"isPK": False, "value": "z"}}]}
    assert report["rows"]["diff"][0]["v"] == {"isPK": False, "isDiff": True, "dataset1": "y", "dataset2": "q"}
    assert report["summary"]["rows"]["updated"] == 1
    assert json_error(ValueError("no"))["status"] == "failed"


def test_schema_diff_and_patterns(spark):
    a = frame(spark, [], "id long, x int, old string")
    b = frame(spark, [], "id long, x string, new string")
    assert schema_diff(a, b) == {"removed": ["old"], "added": ["new"], "changed": [("x", "int", "string")]}
    assert expand(["%"], a, b, skip={"id"}) == ["x"]
    with pytest.raises(ValueError, match="second"):
        expand(["old"], a, b)
    with pytest.raises(ValueError, match="first"):
        expand(["new"], a, b)


def test_plans_push_down_and_stay_in_the_jvm(spark):
    a = spark.range(1000).select("id", F.col("id").alias("v"), F.lit("unused").alias("w"))
    path = written(a, spark)
    side = Segment(spark.read.parquet(path), extras=("v",), min_key=Vector((5,)))
    for df in (JoinDiff(side, side).rows(), HashDiff(side, side, buckets=4).rows()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<id:bigint,v:bigint>" in plan
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
