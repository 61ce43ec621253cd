"""Sources, sinks, configuration, command line, builder, monitor and projects."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veridelta import cli, config
from veridelta.dbt_project import Project, diff_models, unique_columns
from veridelta.errors import ConfigError, ConnectError, QueryBuildError
from veridelta.operators import builder as B
from veridelta.sources import sinks
from veridelta.sources.connect import Connect, connect, connect_to_table, match_path, redacted
from veridelta.streaming.monitor import checksum_windows, drifted


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


# --- sources and sinks ----------------------------------------------------


@pytest.mark.parametrize(
    "uri, url",
    [
        ("postgresql://u:p@h/db", "jdbc:postgresql://h:5432/db"),
        ("mysql://u:p@h:3307/db", "jdbc:mysql://h:3307/db"),
        ("trino://u@h/cat/sch", "jdbc:trino://h:8080/cat/sch"),
        ("clickhouse://u:p@h", "jdbc:clickhouse://h:8123/"),
        ("duckdb:///tmp/x.db", "jdbc:duckdb:/tmp/x.db"),
        ("duckdb://data/x.db", "jdbc:duckdb:data/x.db"),
    ],
)
def test_addresses(spark, uri, url):
    source = Connect()(spark, uri)
    assert source.options["url"] == url


@pytest.mark.parametrize(
    "uri", ["nothing://h/db", "postgresql://u:p@h", "postgresql://h/db/more", "postgresql+x://h/db", "snowflake://u:p@acc/db/sch", "mysql://h/db?a=1&a=2"]
)
def test_bad_addresses(spark, uri):
    with pytest.raises(ConnectError):
        Connect()(spark, uri)


def test_sources_are_shared_until_closed(spark, tmp_path):
    uri = f"parquet://{tmp_path}"
    with connect(spark, uri) as a:
        assert connect(spark, uri) is a and connect(spark, uri, shared=False) is not a
    assert connect(spark, uri) is not a
    with pytest.raises(ConnectError):
        connect.for_databases("mysql")(spark, uri)
    with pytest.raises(ConnectError):
        connect(spark, {"path": "x"})


def test_paths_and_secrets():
    assert match_path(("a", "b?"), "/x") == {"a": "x", "b": ""}
    assert redacted("postgresql://me:secret@h/db") == "postgresql://me:***@h/db"
    assert redacted({"driver": "x", "password": "p"}) == {"driver": "x", "password": "***"}


def test_files(spark, tmp_path):
    df = spark.range(5)
    save(df, tmp_path, "t")
    segment = connect_to_table(spark, f"parquet://{tmp_path}", "t")
    assert segment.count() == 5 and connect(spark, f"parquet://{tmp_path}").schema("t") == {"id": "bigint"}
    df.write.option("header", True).csv(f"{tmp_path}/c")
    assert connect(spark, f"csv://{tmp_path}?header=true").table("c").columns == ["id"]
    (tmp_path / "d.toml").write_text(f'[database.x]\ndriver = "parquet"\npath = "{tmp_path}"\n')
    assert connect(spark, f"toml://{tmp_path}/d.toml#x").table("t").count() == 5


def test_sinks(spark):
    sinks.create_table(spark, "t_sink", "id long, v string")
    sinks.insert_rows(spark, "t_sink", [(1, "a"), (2, None)])
    sinks.insert_rows(spark, "t_sink", [(3,)], ["id"])
    sinks.insert_query(spark.range(1).select(F.lit("q").alias("v"), F.lit(9).alias("id")), "t_sink")
    assert {tuple(r) for r in spark.table("t_sink").collect()} == {(1, "a"), (2, None), (3, None), (9, "q")}
    sinks.append_to_table(spark.table("t_sink"), "t_more")
    sinks.append_to_table(spark.table("t_sink"), "t_more")
    assert spark.table("t_more").count() == 8
    sinks.truncate_table(spark, "t_sink")
    assert spark.table("t_sink").count() == 0
    for t in ("t_sink", "t_more", "t_missing"):
        sinks.drop_table(spark, t)
    assert not spark.catalog.tableExists("t_sink")
    assert sinks.name_from_template("d_%t", datetime(2022, 1, 2, 3, 4, 5)) == "d_2022-01-02_03_04_05"


# --- configuration and command line --------------------------------------

CONF = """
[database.x]
driver = "parquet"
path = "${VERIDELTA_TEST_PATH}"
[run.default]
key_columns = ["id"]
verbose = true
[run.a]
verbose = false
1.database = "x"
1.table = "t"
2.database = "x"
2.table = "u"
"""


def test_config(monkeypatch):
    monkeypatch.setenv("VERIDELTA_TEST_PATH", "/data")
    got = config.run_options(CONF, "a", {"table2": "w", "limit": None})
    assert got["verbose"] is False and got["database1"]["path"] == "/data" and (got["table1"], got["table2"]) == ("t", "w")
    monkeypatch.delenv("VERIDELTA_TEST_PATH")
    assert config.run_options(CONF, "a")["database1"]["path"] == ""
    with pytest.raises(ConfigError):
        config.run_options(CONF, "nothing")
    with pytest.raises(ConfigError):
        config.run_options("[[")


def run(spark, *argv):
    lines = []
    assert cli.run(spark, cli.options(list(argv)), lines.append) == 0
    return lines


def test_command_line(spark, tmp_path):
    rows = [(i, datetime(2022, 1, i + 1), f"v{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, at timestamp, text_comment string")
    save(df, tmp_path, "t")
    save(df.filter("id < 4"), tmp_path, "u")
    uri = f"parquet://{tmp_path}"
    assert run(spark, uri, "t", "u", "-c", "text%") == ["- 4, v4"]
    assert run(spark, uri, "t", uri, "u", "-c", "text%", "--json", "-a", "hashdiff") == ['["-", ["4","v4"]]']
    assert "1 rows exclusive to table A (not present in B)" in run(spark, uri, "t", "u", "-s")[0]
    assert json.loads(run(spark, uri, "t", "u", "-s", "--json")[0])["exclusive_A"] == 1
    assert run(spark, uri, "t", "u", "-t", "at", "--max-age", "1h") == []
    assert run(spark, uri, "t", "u", "-w", "id = 4", "-l", "1", "-j", "serial") == ["- 4"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        run(spark, uri, "t", "u", "-s", "-l", "1")
    for bad in ("0", "x"):
        with pytest.raises(ValueError):
            cli.threads(bad)
    assert cli.main([uri, "t", "missing"]) == 1


# --- builder --------------------------------------------------------------


def test_builder(spark):
    t = B.table(spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id long, s string, n long"))
    this = B.this
    assert t.select(this.id, twice=this.n + this.n).where(this.id > 1).query(list[tuple]) == [(2, 12), (3, 14)]
    assert t.where(B.SKIP, None).count() == 3
    assert t.where(B.equals(this.s, None)).select(this.id).query(int) == 3
    assert t.where(B.or_(this.id == 1, B.and_(this.s.like("b%"), B.in_(this.n, [6])))).count() == 2
    case = B.when(this.n > 6).then("big").when(this.n > 5).then("mid").else_("small")
    assert t.select(case).query(list[str]) == ["small", "mid", "big"]
    with pytest.raises(QueryBuildError):
        B.when(this.n > 1).else_(2)
    with pytest.raises(QueryBuildError):
        t.group_by(this.s).agg()
    assert t.group_by(this.n % 2).having(F.count("*") > 1).agg(B.count("*")).count() == 1
    u = B.table(spark.createDataFrame([(2, "x")], "k long, w string"))
    assert B.join(t, u).on(t["id"] == u["k"]).select(t["id"], u["w"]).query(list[tuple]) == [(2, "x")]
    assert B.leftjoin(t, u).on(t["id"] == u["k"]).select(u["w"]).count() == 3
    assert B.outerjoin(t, u).on(t["id"] == u["k"] + 7).select().count() == 4
    assert t.exists(u, t["id"] == u["k"]).count() == 1 and t.not_exists(u, t["id"] == u["k"]).count() == 2
    assert t.union(t).count() == 3 and t.union_all(t).count() == 6 and t.minus(t).count() == 0 and t.intersect(t).count() == 3
    assert t.cte("a", "b", "c").columns == ["a", "b", "c"]
    assert "Physical Plan" in t.explain()
    assert t.order_by(this.id).limit(1).query(list[dict]) == [{"id": 1, "s": "a", "n": 5}]
    assert t.select(B.code("{x} * 2", x="n")).query(list[int]) == [10, 12, 14]
    with pytest.raises(QueryBuildError):
        t.where(this.id > 99).select(this.id).query(int)


# --- streaming ------------------------------------------------------------


def test_monitor_in_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2022, 1, 1, i % 5, i % 60), f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at timestamp, v string")
    save(df, tmp_path, "in")
    batch = checksum_windows(df, ["id"], "at", ["id", "v"], buckets=4)
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stream = checksum_windows(source, ["id"], "at", ["id", "v"], buckets=4)
    query = stream.writeStream.format("memory").queryName("monitor").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert drifted(batch, spark.table("monitor")).count() == 0
    other = checksum_windows(df.withColumn("v", F.when(F.col("id") == 7, "changed").otherwise(F.col("v"))), ["id"], "at", ["id", "v"], buckets=4)
    assert drifted(batch, other).count() == 1


# --- projects -------------------------------------------------------------


def test_unique_columns():
    assert unique_columns("id") == ["id"]
    assert unique_columns("concat(a, b)") == ["a", "b"]
    assert unique_columns("a || '-' || b") == ["a", "b"]


def test_project(spark, tmp_path):
    target = tmp_path / "target"
    target.mkdir()
    model = {"unique_id": "model.m", "name": "m", "resource_type": "model", "schema": "dev_m", "columns": {"id": {"tags": ["primary-key"]}}}
    test = {"resource_type": "test", "test_metadata": {"name": "unique", "kwargs": {"column_name": "a || b"}}, "depends_on": {"nodes": ["model.n"]}}
    other = {"unique_id": "model.n", "name": "n", "resource_type": "model", "schema": "dev_m"}
    manifest = {"nodes": {"model.m": model, "model.n": other, "test.n": test}, "metadata": {}}
    (target / "manifest.json").write_text(json.dumps(manifest))
    (target / "run_results.json").write_text(json.dumps({"results": [{"unique_id": "model.m", "status": "success"}]}))
    project = Project(tmp_path)
    assert [m.name for m in project.models()] == ["m"] and [m.name for m in project.models("*")] == ["m", "n"]
    assert project.primary_key(project.models("n")[0]) == ["a", "b"]
    with pytest.raises(ValueError):
        project.production(project.models()[0])
    for db, rows in (("dev_m", [(1, 1), (2, 9)]), ("prod_m", [(1, 1), (2, 2), (3, 3)])):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
        spark.createDataFrame(rows, "id long, v long").write.mode("overwrite").saveAsTable(f"{db}.m")
    ((name, text),) = diff_models(spark, {"dbt_project_dir": str(tmp_path), "prod_schema": "prod_m"})
    assert name == "m" and "removed    1" in text and "updated    1" in text and "v: 1 values changed" in text
    for db in ("dev_m", "prod_m"):
        spark.sql(f"DROP DATABASE {db} CASCADE")
