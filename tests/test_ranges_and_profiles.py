"""Bisection by key ranges, names that clash, large sums, and profiles."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veridelta import Segment, diff_tables
from veridelta.dbt_profile import project_source, rendered
from veridelta.errors import ConnectError
from veridelta.functions import checksum as C
from veridelta.functions.keyspace import Vector, outer_boxes
from veridelta.functions.logical import LogicalType
from veridelta.operators.hashdiff import HashDiff, sign_column
from veridelta.operators.joindiff import JoinDiff
from veridelta.operators.rangediff import RangeDiff, merged
from veridelta.operators.result import json_report
from veridelta.plans import catalogue
from veridelta.sources.pushdown import FORMS, RemoteTable
from veridelta.streaming.monitor import checksum_windows


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_ranges_find_what_buckets_find(spark, seed):
    rng = random.Random(seed)
    keys = rng.sample(range(-500, 500), 450) + [rng.randrange(10**6, 10**15) for _ in range(450)]
    rows = [(k, i % 7, rng.choice("xyz")) for i, k in enumerate(keys)] + [(None, 1, "x")]
    other = [(k, n, v if rng.random() > 0.02 else "!") for k, n, v in rows if rng.random() > 0.02] + [(-(10**12), 1, "new")]
    sides = [Segment(spark.createDataFrame(x, "id long, n long, v string"), ("id",), extras=("n", "v")) for x in (rows, other)]
    differ = RangeDiff(*sides, factor=4, threshold=20)
    assert bag(differ.rows()) == bag(HashDiff(*sides).rows())
    assert len(differ.levels) > 1 and differ.levels[-1]["ranges"] < 300


def test_ranges_edges(spark):
    a = Segment(spark.createDataFrame([(1, "x")], "id long, v string"), ("id",), extras=("v",))
    none = Segment(a.df.limit(0), ("id",), extras=("v",))
    assert bag(RangeDiff(a, a).rows()) == Counter() and bag(RangeDiff(none, none).rows()) == Counter()
    assert bag(RangeDiff(a, none).rows()) == Counter({("-", "1", "x"): 1})
    assert bag(diff_tables(none, a, algorithm="rangediff").df) == Counter({("+", "1", "x"): 1})
    with pytest.raises(NotImplementedError):
        RangeDiff(*(Segment(a.df, ("v",), extras=("id",)) for _ in range(2)))


def test_ranges_filter_the_scan(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id % 10 as v")
    df.write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.withColumn("v", F.when(F.col("id") == 4321, -1).otherwise(F.col("v")))
    differ = RangeDiff(*(Segment(x, ("id",), extras=("v",)) for x in (a, b)), factor=10, threshold=60)
    assert bag(differ.rows()) == Counter({("-", "4321", "1"): 1, ("+", "4321", "-1"): 1})
    ((low, high),) = differ.search()
    assert low <= 4321 < high and high - low < 100
    assert "GreaterThanOrEqual(id" in differ.rows()._jdf.queryExecution().executedPlan().toString()


def test_intervals_cover_their_ranges():
    assert merged([(0, 5), (5, 9), (20, 30)]) == [(0, 9), (20, 30)]
    assert merged([(0, 1), (10, 11), (12, 13), (50, 51)], 2) == [(0, 13), (50, 51)]
    assert outer_boxes((Vector((2,)), Vector((5,))), (Vector((0,)), Vector((9,)))) == [(Vector((0,)), Vector((2,))), (Vector((5,)), Vector((9,)))]
    assert outer_boxes((Vector((0,)), Vector((9,))), (Vector((2,)), Vector((5,)))) == []


CLASH = "k long, bucket string, _op string, op string, _na string, _low string, sign string, c0 string, cell string, h string, count_a string"


def test_any_column_name_can_be_compared(spark):
    rows = [(i, *(f"{i}{c}" for c in "abcdefghij")) for i in range(30)]
    changed = [(*r[:1], "other", *r[2:]) if r[0] == 3 else r for r in rows if r[0] != 5]
    extras = tuple(c.split()[0] for c in CLASH.split(", ")[1:])
    sides = [Segment(spark.createDataFrame(x, CLASH), ("k",), extras=extras) for x in (rows, changed)]
    assert sign_column(["k", "OP"]) == "op_" and sign_column(["op", "op_"]) == "op__"
    for algorithm in ("joindiff", "hashdiff", "rangediff"):
        got = diff_tables(*sides, algorithm=algorithm)
        assert got.df.columns == ["op_", "k", *extras]
        assert {(r[0], r[1]) for r in got.df.collect()} == {("-", "3"), ("+", "3"), ("-", "5")}
        assert (got.stats["updated"], got.stats["exclusive_A"], got.stats["exclusive_B"]) == (1, 1, 0)
        assert [r[0] for r in got.ordered().collect()] == ["-", "+", "-"]
    with pytest.raises(ValueError, match="wide"):
        JoinDiff(*(Segment(spark.createDataFrame([(1, "x")], "k long, is_exclusive string"), ("k",), extras=("is_exclusive",)) for _ in range(2))).wide()


def test_sums_do_not_overflow(spark):
    same = spark.range(300_000).selectExpr("1 as id", "timestamp '2024-01-01 00:00:00' as at", "'x' as v")
    got = checksum_windows(same, ["id"], "at", ["v"]).collect()
    one = same.limit(1).agg(C.md5_as_int(F.first("v"))).first()[0]
    assert [int(r["checksum"]) for r in got] == [one * 300_000] and abs(one * 300_000) > 2**63


@pytest.mark.parametrize("priority", ["4-NOT SPECIFIED", "y"])
def test_count_and_checksum_beyond_a_long(spark, tmp_path, priority):
    """The sums on both sides of a long's bounds, and past them."""
    one = int(hashlib.md5(priority.encode()).hexdigest()[20:], 16) - C.OFFSET
    most = 2**63 // abs(one)
    for n, kind in ((0, "bigint"), (most, "bigint"), (most + 1, "decimal(38,0)"), (300_000, "decimal(38,0)")):
        orders = spark.range(n).select(F.lit(priority).alias("o_orderpriority"))
        orders.union(spark.sql("SELECT CAST(NULL AS STRING)")).write.parquet(f"{tmp_path}/{n}/orders.parquet")
        got = catalogue.queries()["count_and_checksum"](spark, f"{tmp_path}/{n}")
        assert dict(got.dtypes) == {"n": "bigint", "checksum": kind}
        assert [tuple(r) for r in got.collect()] == [(n + 1, n * one if n else None)]


def test_reports_tell_what_they_leave_out(spark):
    a, b = (Segment(spark.range(n).selectExpr("id", "id as v"), ("id",), extras=("v",)) for n in (50, 0))
    got = diff_tables(a, b, algorithm="joindiff", materialize_to_table="veridelta_limited", table_write_limit=20)
    assert got.extra["rows_not_written"] == 30 and spark.table("veridelta_limited").count() == 20
    doc = json_report(got.sources, got, ("a", "b"), limit=8)
    assert len(doc["rows"]["exclusive"]["dataset1"]) == 8 and doc["rows"]["omitted"] == 42
    assert "omitted" not in json_report(got.sources, got, ("a", "b"))["rows"]


PROFILES = """
shop:
  target: dev
  outputs:
    dev: {type: postgres, host: "{{ env_var('VERIDELTA_TEST_HOST') }}", port: 5433, dbname: shop, user: me, pass: "{{ env_var('VERIDELTA_NO_SUCH', 'pw') }}"}
    key: {type: snowflake, account: acc, database: d, schema: s, warehouse: w, user: me, private_key_path: /k.p8, private_key_passphrase: pp}
    both: {type: snowflake, account: acc, password: x, private_key_path: /k.p8}
    none: {type: snowflake, account: acc}
    big: {type: bigquery, method: service-account, project: p, dataset: ds, keyfile: /k.json}
    oddbig: {type: bigquery, method: token}
    iam: {type: redshift, method: iam, host: h}
    bricks: {type: databricks, host: h, http_path: sql/1, catalog: c, schema: s, token: t}
"""


def test_profiles(tmp_path, monkeypatch, spark):
    monkeypatch.setenv("VERIDELTA_TEST_HOST", "db.example.org")
    (tmp_path / "dbt_project.yml").write_text("name: shop\nprofile: shop\n")
    (tmp_path / "profiles.yml").write_text(PROFILES)
    got = project_source(tmp_path)
    assert got == {"driver": "postgresql", "host": "db.example.org", "port": 5433, "database": "shop", "user": "me", "password": "pw"}
    from veridelta.sources.connect import Connect

    options = lambda target: Connect()(spark, project_source(tmp_path, target=target)).options
    assert options("dev")["url"] == "jdbc:postgresql://db.example.org:5433/shop"
    key = options("key")
    assert key["private_key_file"] == "/k.p8" and key["private_key_file_pwd"] == "pp" and "db=d&schema=s" in key["url"]
    assert options("big")["OAuthPvtKeyPath"] == "/k.json" and "ProjectId=p;DefaultDataset=ds" in options("big")["url"]
    assert options("bricks")["PWD"] == "t" and "httpPath=/sql/1;ConnCatalog=c" in options("bricks")["url"]
    for bad in ("both", "none", "oddbig", "iam", "absent"):
        with pytest.raises(ConnectError):
            project_source(tmp_path, target=bad)
    with pytest.raises(ConnectError):
        rendered("{{ env_var('VERIDELTA_NO_SUCH') }}")


# --- sums in the database -----------------------------------------------------

REMOTE = "SELECT i AS id, i % 7 AS n, CAST(i + 0.25 AS DECIMAL(18,2)) AS d, CASE WHEN i % 5 = 0 THEN NULL ELSE 'v' || i END AS \"s t\", i % 2 = 0 AS b, DATE '2024-01-01' + CAST(i % 300 AS INT) AS day, TIMESTAMP '2024-01-01 00:00:00.5' + to_minutes(i) AS ts"


def test_sums_of_a_database_agree_with_spark(spark):
    """DuckDB stands for the database: its sums against Spark's of the same rows."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS {REMOTE} FROM generate_series(1, 4000) g(i)")
    schema = "id long, n long, d decimal(18,2), `s t` string, b boolean, day date, ts timestamp"
    asked = []

    def run(sql):
        asked.append(sql)
        got = con.execute(sql).fetchall()
        names = [c[0] for c in con.description]
        kinds = {f.split()[0]: f.split()[-1] for f in schema.replace("`s t`", "s_t").split(", ")} | {"cell": "long", "s": "decimal(38,0)", "low": "long", "high": "long"}
        return spark.createDataFrame(got, ", ".join(f"`{c}` {kinds[c.replace(' ', '_')]}" for c in names))

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    whole = spark.createDataFrame(con.execute("SELECT id, n, d, \"s t\", b, day, ts FROM t").fetchall(), schema)
    extras = ("n", "d", "s t", "b", "day", "ts")
    remote = RemoteTable("duckdb", "t", run)
    side = Segment(whole, ("id",), extras=extras)
    assert bag(RangeDiff(side, side, remote=(remote, None), factor=8, threshold=100).rows()) == Counter()
    changed = whole.filter("id <> 77").withColumn("s t", F.when(F.col("id") == 3210, "else").otherwise(F.col("s t")))
    other = Segment(changed, ("id",), extras=extras)
    asked.clear()
    got = RangeDiff(side, other, remote=(remote, None), factor=8, threshold=100).rows().collect()
    assert sorted((r[0], r[1]) for r in got) == [("+", "3210"), ("-", "3210"), ("-", "77")]
    # No query but the last reads rows, and that only of the ranges that disagree.
    *sums, rows = asked
    assert all("SUM(" in q or "MIN(" in q for q in sums) and len(con.execute(rows).fetchall()) < 200
    both = RangeDiff(side, other, remote=(remote, RemoteTable("duckdb", "(SELECT * FROM t WHERE id <> 77) u", run)), factor=8, threshold=100).rows()
    assert {(r[0], r[1]) for r in both.collect()} == {("-", "77")}


def test_every_database_has_its_words():
    for kind, forms in FORMS.items():
        t = RemoteTable(kind, "t", None)
        sql = t.sums_sql("id", [t.text("v", LogicalType("text")), t.text("n", LogicalType("integer"))], 0, 10, [(0, 5)], "n > 1")
        assert sql.count("MD5") == 1 and "<null>" in sql and "(n > 1) AND" in sql and forms.quote in sql
    with pytest.raises(NotImplementedError):
        RemoteTable("parquet", "t", None)
    with pytest.raises(NotImplementedError):
        RemoteTable("mysql", "t", None).text("x", LogicalType("float", 2))
