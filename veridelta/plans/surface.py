"""Queries of the parts that work beside the rows: keys, sources, sinks, reports,
options. Each gives its answer as a small frame, beside SQL that must agree."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta import cli, config
from veridelta.dbt_profile import source_of
from veridelta.dbt_project import Project, summary, unique_columns
from veridelta.functions import keyspace as K
from veridelta.functions import normalize as N
from veridelta.functions.ages import age, before
from veridelta.functions.logical import binary_digits, logical_schema, refined
from veridelta.operators import builder as B
from veridelta.operators.diff import diff_tables
from veridelta.operators.hashdiff import HashDiff, check_options
from veridelta.operators.joindiff import JoinDiff
from veridelta.operators.result import json_error, json_report, number_to_human
from veridelta.operators.schema_diff import expand, kinds, matching
from veridelta.operators.segment import Segment
from veridelta.sources import sinks
from veridelta.sources.connect import connect, connect_to_table, match_path, redacted

from .catalogue import _diff_sql, _pair, query, t
from .fixtures import CHANGED, scratch, table

V = K.Vector


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def raised(f) -> str | None:
    """Name of the error that a call ends with."""
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return None


# --- keys and segments --------------------------------------------------------

_ENDS = "SELECT min(conv_id) AS lo1, max(conv_id) + 1 AS hi1, min(turn) AS lo2, max(turn) + 1 AS hi2 FROM conversations"


def _span(spark: SparkSession, d: str) -> tuple[K.Vector, K.Vector]:
    low, high = Segment(table(spark, d, "conversations"), ("conv_id", "turn")).key_range()
    return low, high + 1


#: With two keys, 16 boxes are wanted: 4 points between on each side, 1 where the side has no more than 4 values.
_POINTS = f"""
SELECT dim, i, CASE WHEN i = 0 THEN lo WHEN i = n + 1 THEN hi ELSE lo + (hi - lo) * i // (n + 1) END AS point
FROM (SELECT *, CASE WHEN hi - lo <= 4 THEN 1 ELSE 4 END AS n FROM (
  SELECT 0 AS dim, lo1 AS lo, hi1 AS hi FROM ({_ENDS}) x UNION ALL SELECT 1, lo2, hi2 FROM ({_ENDS}) y) z) s,
  (SELECT unnest(generate_series(0, 5)) AS i) g WHERE i <= n + 1"""


@query(_POINTS)
def key_checkpoints(spark, d):
    points = K.checkpoints(*_span(spark, d), 16)
    return frame(spark, [(k, i, int(p)) for k, ps in enumerate(points) for i, p in enumerate(ps)], "dim int, i int, point long")


_BOXES = f"""
SELECT a.point AS low1, b.point AS high1, p.point AS low2, q.point AS high2
FROM ({_POINTS}) a JOIN ({_POINTS}) b ON a.dim = 0 AND b.dim = 0 AND b.i = a.i + 1
JOIN ({_POINTS}) p ON p.dim = 1 JOIN ({_POINTS}) q ON q.dim = 1 AND q.i = p.i + 1"""
_BOX = "low1 long, high1 long, low2 long, high2 long"


@query(_BOXES)
def key_mesh(spark, d):
    boxes = K.mesh(K.checkpoints(*_span(spark, d), 16))
    return frame(spark, [tuple(int(x) for ab in zip(low, high) for x in ab) for low, high in boxes], _BOX)


@query(f"SELECT x.*, (SELECT count(*) FROM conversations WHERE conv_id >= low1 AND conv_id < high1 AND turn >= low2 AND turn < high2) AS n FROM ({_BOXES}) x")
def key_segments(spark, d):
    """Rows of each box of a segment."""
    low, high = _span(spark, d)
    s = Segment(table(spark, d, "conversations"), ("conv_id", "turn"), min_key=low, max_key=high)
    parts = [
        x.rows().agg(*(F.lit(int(v)).alias(n) for n, v in zip(("low1", "high1", "low2", "high2"), (v for ab in zip(x.min_key, x.max_key) for v in ab))), F.count("*").alias("n"))
        for x in s.segments(16)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"SELECT (hi1 - lo1) * (hi2 - lo2) AS size, (SELECT count(*) FROM conversations WHERE conv_id < 20 AND conv_id >= lo1 AND turn < 3 AND turn >= lo2) AS inside, 'ValueError' AS beyond FROM ({_ENDS}) x")
def key_bounds(spark, d):
    low, high = _span(spark, d)
    s = Segment(table(spark, d, "conversations"), ("conv_id", "turn"), min_key=low, max_key=high)
    inner = s.bounded(low, V((20, 3)))
    return frame(spark, [(int(s.approximate_size()), inner.count(), raised(lambda: inner.bounded(low, high)))], "size long, inside long, beyond string")


@query(
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey < b.n_nationkey AND a.n_regionkey < b.n_regionkey AS less,
       a.n_nationkey <= b.n_nationkey AND a.n_regionkey <= b.n_regionkey AS at_most, a.n_nationkey - b.n_nationkey AS d1, a.n_regionkey - b.n_regionkey AS d2
FROM nation a CROSS JOIN nation b"""
)
def key_vectors(spark, d):
    rows = [V((r[0], r[1])) for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]
    out = [(x.parts[0], y.parts[0], x < y, x <= y, *(x - y)) for x in rows for y in rows]
    return frame(spark, [tuple(int(v) if not isinstance(v, bool) else v for v in r) for r in out], "a long, b long, less boolean, at_most boolean, d1 long, d2 long")


@query("SELECT n_nationkey AS n, n_regionkey * 100 + n_nationkey AS number, n_regionkey AS k1, n_nationkey AS k2, (n_regionkey * 100 + n_nationkey + 205) // 100 AS s1, (n_regionkey * 100 + n_nationkey + 205) % 100 AS s2 FROM nation")
def key_lexicographic(spark, d):
    space, out = K.LexicographicSpace((1000, 100)), []
    for n, r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        number = space.number((r, n))
        out.append((n, number, *space.key(number), *space.add((r, n), (2, 5))))
    return frame(spark, out, "n long, number long, k1 long, k2 long, s1 long, s2 long")


@query(
    """SELECT a.p AS low1, b.p AS high1, c.p AS low2, e.p AS high2 FROM (VALUES (0, 0), (1, 10), (2, 20), (3, 30)) a(i, p) JOIN (VALUES (0, 0), (1, 10), (2, 20), (3, 30)) b(i, p) ON b.i = a.i + 1
JOIN (VALUES (0, 5), (1, 5), (2, 8), (3, 9)) c(i, p) ON TRUE JOIN (VALUES (0, 5), (1, 5), (2, 8), (3, 9)) e(i, p) ON e.i = c.i + 1
WHERE a.p < b.p AND c.p < e.p AND NOT (a.i = 1 AND c.i = 1)"""
)
def key_outer_boxes(spark, d):
    boxes = K.outer_boxes((V((10, 5)), V((20, 8))), (V((0, 6)), V((30, 9))))
    return frame(spark, [tuple(x for ab in zip(low, high) for x in ab) for low, high in boxes], _BOX)


_CHECKS = [("equal bounds", "ValueError"), ("factor over threshold", "ValueError"), ("factor of one", "ValueError"), ("no bounds", None), ("unknown column", "ValueError"), ("update bounds alone", "ValueError")]


@query(values(_CHECKS, "what, error"))
def option_checks(spark, d):
    nation = table(spark, d, "nation")
    calls = {
        "equal bounds": lambda: Segment(nation, ("n_nationkey",), min_key=V((3,)), max_key=V((3,))),
        "factor over threshold": lambda: check_options(32, 16),
        "factor of one": lambda: check_options(1, 16),
        "no bounds": lambda: Segment(nation, ("n_nationkey",)),
        "unknown column": lambda: Segment(nation, ("nothing",)),
        "update bounds alone": lambda: Segment(nation, ("n_nationkey",), min_update=datetime(2020, 1, 1)),
    }
    return frame(spark, [(k, raised(f)) for k, f in calls.items()], "what string, error string")


# --- sources and sinks ----------------------------------------------------------


@query(values([("parquet", "parquet", True), ("shared", "parquet", True), ("other", "ConnectError", False), ("no driver", "ConnectError", False)], "what, kind, ok"))
def connect_kinds(spark, d):
    a = connect(spark, f"parquet://{d}")
    rows = [("parquet", a.kind, True), ("shared", a.kind, connect(spark, f"parquet://{d}") is a)]
    rows += [("other", raised(lambda: connect.for_databases("mysql")(spark, f"parquet://{d}")), False), ("no driver", raised(lambda: connect(spark, {"path": d})), False)]
    return frame(spark, rows, "what string, kind string, ok boolean")


@query(values([("db/main", "db", "main"), ("db", "db", ""), ("a%20b/c", "a b", "c")], "path, database, schema"))
def connect_paths(spark, d):
    got = [(p, match_path(("database", "schema?"), p)) for p in ("db/main", "db", "a%20b/c")]
    return frame(spark, [(p, v["database"], v["schema"]) for p, v in got], "path string, database string, schema string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def connect_table_segment(spark, d):
    s = connect_to_table(spark, f"parquet://{d}", "nation.parquet", "n_nationkey", extras=("n_name",), max_key=V((9,)))
    return s.rows().select("n_nationkey", "n_name")


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type FROM (DESCRIBE SELECT * FROM orders) x")
def source_schema(spark, d):
    return frame(spark, list(connect(spark, f"parquet://{d}").schema("orders.parquet").items()), "name string, type string")


@query(values([(True, "UTC", False)], "closed, zone, same"))
def source_closes(spark, d):
    with connect(spark, f"csv://{d}") as s:
        pass
    return frame(spark, [(s.is_closed, spark.conf.get("spark.sql.session.timeZone"), connect(spark, f"csv://{d}") is s)], "closed boolean, zone string, same boolean")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region")
def sink_truncate_append(spark, d):
    name, region = scratch(spark, "append"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.drop_table(spark, name)
    sinks.append_to_table(region, name)
    sinks.truncate_table(spark, name)
    sinks.append_to_table(region, name)
    sinks.append_to_table(region.withColumn("r_regionkey", F.col("r_regionkey") + 10), name)
    return spark.table(name)


@query("SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey > 1")
def sink_temp_table(spark, d):
    return sinks.temp_table(table(spark, d, "region").selectExpr("r_regionkey as k", "r_name as v").filter("k > 1"), "veridelta_temp")


@query("SELECT i::BIGINT AS id, 'row ' || i AS s FROM generate_series(0, 9999) g(i)")
def sink_many_rows(spark, d):
    name = scratch(spark, "many_rows")
    sinks.drop_table(spark, name)
    sinks.create_table(spark, name, "id BIGINT, s STRING")
    sinks.insert_rows(spark, name, ((i, f"row {i}") for i in range(10_000)), ["id", "s"])
    return spark.table(name)


@query("SELECT 'diff_' || strftime(TIMESTAMP '2024-02-03 04:05:06', '%Y-%m-%d_%H_%M_%S') AS name, '`a`.`b c`' AS quoted")
def sink_names(spark, d):
    return frame(spark, [(sinks.name_from_template("diff_%t", datetime(2024, 2, 3, 4, 5, 6)), sinks.quoted("a.b c"))], "name string, quoted string")


# --- results ----------------------------------------------------------------------

_ROWS = _diff_sql("orders")


def _result(spark: SparkSession, d: str):
    return diff_tables(*_pair(spark, d, "orders"), algorithm="joindiff", validate_unique_key=False)


@query(f"SELECT op || ' ' || o_orderkey || ', ' || o_totalprice || ', ' || coalesce(o_orderstatus, 'None') AS line FROM ({_ROWS}) r")
def report_text_rows(spark, d):
    return frame(spark, [(x,) for x in _result(spark, d).text_rows()], "line string")


@query(f"""SELECT '["' || op || '", ["' || o_orderkey || '","' || o_totalprice || '",' || coalesce('"' || o_orderstatus || '"', 'null') || ']]' AS value FROM ({_ROWS}) r""")
def report_json_lines(spark, d):
    return _result(spark, d).json_lines()


@query(f"SELECT * FROM ({_ROWS}) r ORDER BY o_orderkey, op DESC LIMIT 15")
def diff_ordered_limit(spark, d):
    """The first rows by the text of their keys."""
    return _result(spark, d).ordered().limit(15)


_COUNTS = f"""
SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM ({CHANGED['orders']}) b) AS b,
  count(*) FILTER (m = 1 AND p = 0) AS xa, count(*) FILTER (m = 0 AND p = 1) AS xb, count(*) FILTER (m = 1 AND p = 1) AS u
FROM (SELECT max(CAST(op = '-' AS INT)) AS m, max(CAST(op = '+' AS INT)) AS p FROM ({_ROWS}) r GROUP BY o_orderkey) f"""


@query(
    f"""SELECT unnest([a || ' rows in table A', b || ' rows in table B', xa || ' rows exclusive to table A (not present in B)', xb || ' rows exclusive to table B (not present in A)',
  u || ' rows updated', (a - xa - u) || ' rows unchanged', printf('%.2f', 100 * (1 - (a - xa - u) / greatest(a, b)::DOUBLE)) || '% difference score']) AS line FROM ({_COUNTS}) c"""
)
def report_text_stats(spark, d):
    return frame(spark, [(x,) for x in _result(spark, d).text_stats().split("\n")], "line string")


@query(f"SELECT a, b, xa, xb, u, a - xa - u AS unchanged, '1.1.0' AS version, 'different' AS result, 'o_orderkey' AS key FROM ({_COUNTS}) c")
def report_json_summary(spark, d):
    got = _result(spark, d)
    doc = json_report(got.sources, got, ("a", "b"), limit=5)
    s = doc["summary"]["rows"]
    row = (s["total"]["dataset1"], s["total"]["dataset2"], s["exclusive"]["dataset1"], s["exclusive"]["dataset2"], s["updated"], s["unchanged"], doc["version"], doc["result"], ",".join(doc["columns"]["primaryKey"]))
    return frame(spark, [row], "a long, b long, xa long, xb long, u long, unchanged long, version string, result string, key string")


@query(values([("1.0.0", "failed", "ValueError: broken")], "version, status, error"))
def report_json_error(spark, d):
    e = json_error(ValueError("broken"))
    return frame(spark, [(e["version"], e["status"], e["error"])], "version string, status string, error string")


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'datetime' ELSE 'string' END AS kind FROM (DESCRIBE SELECT * FROM orders) x")
def report_kinds(spark, d):
    return frame(spark, list(kinds(table(spark, d, "orders")).items()), "name string, kind string")


@query(values([("postgresql://me:***@h/db",), ("***",), ("x",)], "shown"))
def report_redacted(spark, d):
    conf = redacted({"password": "secret", "name": "x"})
    return frame(spark, [(redacted("postgresql://me:pw@h/db"),), (conf["password"],), (conf["name"],)], "shown string")


@query(values([(999, "999"), (1000, "1k"), (2_500_000, "2m"), (3_000_000_000, "3b")], "n, shown"))
def report_human_numbers(spark, d):
    return frame(spark, [(n, number_to_human(n)) for n in (999, 1000, 2_500_000, 3_000_000_000)], "n long, shown string")


@query(f"SELECT a AS rows_a, b AS rows_b, 1 AS some, 1 AS enough FROM ({_COUNTS}) c")
def hashdiff_info(spark, d):
    """Totals over the buckets; rows compared are no fewer than those that differ."""
    differ = HashDiff(*_pair(spark, d, "orders"), buckets=128)
    got = differ.info()
    changed = differ.rows().select("o_orderkey").distinct().count()
    return frame(spark, [(got["rows_a"], got["rows_b"], int(got["buckets_compared"] > 0), int(got["rows_compared"] * 2 >= changed))], "rows_a long, rows_b long, some int, enough int")


@query(values([("auto", "joindiff"), ("auto remote", "hashdiff"), ("hashdiff", "hashdiff"), ("other", "ValueError")], "asked, used"))
def diff_algorithms(spark, d):
    a, b = _pair(spark, d, "customer")
    used = lambda **o: diff_tables(a, b, validate_unique_key=False, **o).algorithm
    rows = [("auto", used()), ("auto remote", used(remote=True)), ("hashdiff", used(algorithm="hashdiff")), ("other", raised(lambda: used(algorithm="x")))]
    return frame(spark, rows, "asked string, used string")


# --- builder ----------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey AS c FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30) x WHERE o_custkey > 10")
def nested_after_limit(spark, d):
    orders = B.table(table(spark, d, "orders"))
    return orders.order_by(t.o_orderkey).limit(30).where(t.o_custkey > 10).select(t.o_orderkey, c=t.o_custkey).df


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_custkey < 50")
def hints_and_columns(spark, d):
    orders = B.table(table(spark, d, "orders"))
    return orders.where(orders["o_custkey"] < 50, B.SKIP, None).select("o_orderkey", B.SKIP, hints="rebalance", twice=B.code("{c} * 2", c="o_totalprice")).df


@query("SELECT 5 AS n, 'x' AS s, CAST(NULL AS VARCHAR) AS nothing, true AS yes, TIMESTAMP '2020-01-02 03:04:05' AS at")
def select_one_row(spark, d):
    return B.select_one(spark, n=5, s="x", nothing=F.lit(None).cast("string"), yes=True, at=F.lit("2020-01-02 03:04:05").cast("timestamp_ntz")).df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name > 'C' AND n_nationkey < 15")
def bound_params(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("veridelta_nation")
    return B.with_params(spark, "SELECT n_nationkey, n_name FROM veridelta_nation WHERE n_name > :name AND n_nationkey < :most", name="C", most=15).df


@query("SELECT count(*) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderkey < (SELECT count(*) FROM customer)) AS below FROM orders")
def queries_in_sequence(spark, d):
    orders, customers = (B.table(table(spark, d, n)) for n in ("orders", "customer"))
    count = lambda r: B.Relation(r.df.agg(F.count("*")))

    def steps():
        n = yield count(customers)
        yield count(orders.where(t.o_orderkey < n))

    return frame(spark, [(*B.run_all([count(orders)], int), *B.run_all(steps(), int))], "orders long, customers long, below long")


@query("SELECT min(n_nationkey) AS one, max(n_nationkey) AS last, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation")
def result_coercion(spark, d):
    nation = B.table(table(spark, d, "nation")).order_by(t.n_nationkey)
    ids, names = nation.select(t.n_nationkey).query(list[int]), nation.select(t.n_name).query(list[str])
    return frame(spark, [(nation.select(t.n_nationkey).query(int), nation.select(t.n_nationkey).query(list)[-1][0], len(ids), "|".join(names))], "one long, last long, n long, names string")


@query(values([("scan", True), ("filter", True)], "what, there"))
def explain_text(spark, d):
    text = B.table(table(spark, d, "orders")).where(t.o_orderkey < 5).explain().lower()
    return frame(spark, [(w, w in text) for w in ("scan", "filter")], "what string, there boolean")


@query("SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation")
def set_schema(spark, d):
    """A set operation has the columns of its left side."""
    return B.table(table(spark, d, "region")).select(k=t.r_regionkey).union_all(B.table(table(spark, d, "nation")).select(t.n_nationkey)).df


@query(values([("now", True), ("database", True), ("schema", True)], "what, known"))
def session_functions(spark, d):
    got = B.select_one(spark, now=B.current_timestamp(), database=B.current_database(), schema=B.current_schema()).df.first()
    return frame(spark, [(k, got[k] is not None) for k in ("now", "database", "schema")], "what string, known boolean")


@query(values([("int", "BIGINT"), ("str", "STRING"), ("float", "DOUBLE"), ("bool", "BOOLEAN"), ("datetime", "TIMESTAMP")], "python, name"))
def type_names(spark, d):
    return frame(spark, [(k.__name__, B.type_name(k)) for k in (int, str, float, bool, datetime)], "python string, name string")


# --- values --------------------------------------------------------------------------


@query("SELECT TIMESTAMP '2024-03-10 12:00:00' - INTERVAL 9 DAY - INTERVAL 185 MINUTE AS at, 780305 AS seconds, 2592000 AS month, 'AgeError' AS twice, 'AgeError' AS unknown")
def ages(spark, d):
    at = before(datetime(2024, 3, 10, 12), "1w2d3h5min")
    row = (at, int(age("1w2d45min5s").total_seconds()), int(age("1mon").total_seconds()), raised(lambda: age("1d2d")), raised(lambda: age("5lightyears")))
    return frame(spark, [row], "at timestamp_ntz, seconds long, month long, twice string, unknown string")


@query("SELECT bits, floor(log10(2 ** bits))::BIGINT AS digits FROM (VALUES (11), (24), (53)) v(bits)")
def binary_precision(spark, d):
    return frame(spark, [(b, binary_digits(b)) for b in (11, 24, 53)], "bits int, digits long")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) x WHERE (column_name LIKE 'l_%key' OR column_name LIKE 'l_ta_')")
def column_patterns(spark, d):
    a = table(spark, d, "lineitem")
    assert matching("l_ta?", a.columns) == expand(["l_ta?"], a, a)
    return frame(spark, [(c,) for c in expand(["l_%key", "l_ta?"], a, a)], "name string")


@query("""SELECT event_id, '{"id":' || event_id || ',"k":[1,2]}' AS j, 'no json' AS plain FROM events""")
def normalize_json_text(spark, d):
    spaced = F.concat(F.lit('{ "k" : [1, 2], "id" : '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", N.json_text(spaced).alias("j"), N.json_text(F.lit("no json")).alias("plain"))


@query(values([("c_name", "alphanum"), ("c_custkey", "integer"), ("id", "uuid"), ("words", "text")], "name, kind"))
def refined_types(spark, d):
    df = table(spark, d, "customer").select("c_name", "c_custkey", F.expr("uuid()").alias("id"), F.lit("two words").alias("words"))
    df = df.withColumn("c_name", F.regexp_replace("c_name", "[^0-9A-Za-z]", "-"))
    return frame(spark, [(k, v.kind) for k, v in refined(df, logical_schema(df), df.columns).items()], "name string, kind string")


@query("SELECT o_orderkey, md5(md5(o_orderpriority) || '|' || md5(coalesce(nullif(o_orderstatus, 'P'), '<null>'))) AS h FROM orders")
def concat_hashed(spark, d):
    from veridelta.functions import checksum as C

    texts = [F.col("o_orderpriority"), F.nullif(F.col("o_orderstatus"), F.lit("P"))]
    return table(spark, d, "orders").select("o_orderkey", C.md5_as_hex(C.joined_text(texts, hashed=True)).alias("h"))


# --- command line, configuration, projects -----------------------------------------------


def _lines(spark: SparkSession, argv: list[str]) -> DataFrame:
    out: list[str] = []
    cli.run(spark, cli.options(argv), out.append)
    return frame(spark, [(x,) for x in out], "line string")


_CLI = "SELECT op, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM (SELECT '-' AS op, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 60) x"


@query(f"SELECT op || ' ' || o_orderkey || ', ' || o_orderstatus AS line FROM ({_CLI}) r")
def cli_rows(spark, d):
    """Rows of one table that the other, cut by -w, lacks."""
    table(spark, d, "orders").filter("o_orderkey >= 60").createOrReplaceTempView("veridelta_cli_b")
    return _lines(spark, [f"parquet://{d}", "orders.parquet", "spark://", "veridelta_cli_b", "-k", "o_orderkey", "-c", "o_orderst%"])


@query(f"SELECT op || ' ' || o_orderkey || ', ' || o_orderstatus AS line FROM (SELECT * FROM ({_CLI}) x ORDER BY o_orderkey LIMIT 4) r")
def cli_limit(spark, d):
    table(spark, d, "orders").filter("o_orderkey >= 60").createOrReplaceTempView("veridelta_cli_b")
    return _lines(spark, [f"parquet://{d}", "orders.parquet", "spark://", "veridelta_cli_b", "-k", "o_orderkey", "-c", "o_orderstatus", "-l", "4", "-a", "hashdiff"])


@query(f"""SELECT '["-", ["' || o_orderkey || '","' || o_orderstatus || '"]]' AS line FROM ({_CLI}) r WHERE o_orderkey::BIGINT > 20""")
def cli_json(spark, d):
    table(spark, d, "orders").filter("o_orderkey >= 60").createOrReplaceTempView("veridelta_cli_b")
    return _lines(spark, [f"parquet://{d}", "orders.parquet", "spark://", "veridelta_cli_b", "-k", "o_orderkey", "-c", "o_orderstatus", "--json", "-w", "o_orderkey > 20"])


@query(values([("serial", "1"), ("8", "8"), ("0", "ValueError"), ("x", "ValueError"), ("limit and stats", "ValueError"), ("two places", "ValueError")], "given, meant"))
def cli_options(spark, d):
    rows = [(x, raised(lambda x=x: cli.threads(x)) or str(cli.threads(x))) for x in ("serial", "8", "0", "x")]
    rows.append(("limit and stats", raised(lambda: cli.run(spark, cli.options(["spark://", "a", "b", "-l", "3", "-s"])))))
    rows.append(("two places", raised(lambda: cli.options(["spark://", "a"]))))
    return frame(spark, rows, "given string, meant string")


_TOML = """
[database.main]
driver = "parquet"
path = "${VERIDELTA_NO_SUCH_VARIABLE}/data"
[run.default]
limit = 5
threads = 2
[run.nightly]
limit = 9
1.database = "main"
1.table = "a"
2.database = "main"
2.table = "b"
"""


@query(values([("database1", "/data"), ("limit", "9"), ("table1", "a"), ("table2", "b"), ("threads", "7"), ("unknown run", "ConfigError")], "name, value"))
def config_runs(spark, d):
    got = config.run_options(_TOML, "nightly", {"threads": 7, "where": None})
    rows = [("database1", got["database1"]["path"])] + [(k, str(got[k])) for k in ("limit", "table1", "table2", "threads")]
    return frame(spark, [*rows, ("unknown run", raised(lambda: config.run_options(_TOML, "other")))], "name string, value string")


_MANIFEST = {
    "metadata": {"vars": {"prod_schema": "prod_<schema>"}},
    "nodes": {
        "model.p.a": {"unique_id": "model.p.a", "name": "a", "database": "db", "schema": "dev", "columns": {"id": {"meta": {"primary-key": True}}, "x": {}}},
        "model.p.b": {"unique_id": "model.p.b", "name": "b", "database": "db", "schema": "dev", "meta": {"primary-key": ["k", "l"]}, "columns": {}},
        "model.p.c": {"unique_id": "model.p.c", "name": "c", "schema": "dev", "alias": "cc", "columns": {"u": {}}},
        "model.p.e": {"unique_id": "model.p.e", "name": "e", "schema": "dev", "config": {"materialized": "ephemeral"}},
        "test.p.u": {"resource_type": "test", "test_metadata": {"name": "unique", "kwargs": {"column_name": "concat(u, '-', v)"}}, "depends_on": {"nodes": ["model.p.c"]}},
    },
}
_RESULTS = {"results": [{"unique_id": f"model.p.{m}", "status": s} for m, s in (("a", "success"), ("b", "error"), ("c", "success"), ("e", "success"))]}


@query(values([("a", "db.prod_dev.a", "id"), ("c", "prod_dev.cc", "u,v")], "model, production, keys"))
def project_models(spark, d):
    """Models that the last run built, where they lie in production, and their keys."""
    project = Project.of(_MANIFEST, _RESULTS)
    return frame(spark, [(m.name, project.production(m), ",".join(project.primary_key(m))) for m in project.models()], "model string, production string, keys string")


@query(values([("b", "k,l", "db.dev.b")], "model, keys, path"))
def project_selection(spark, d):
    project = Project.of(_MANIFEST, _RESULTS)
    return frame(spark, [(m.name, ",".join(project.primary_key(m)), m.path) for m in project.models("b*")], "model string, keys string, path string")


@query(values([("a", "a"), ("concat(a, b)", "a,b"), ("a || '-' || b", "a,b"), ("concat(coalesce(a), b)", "a,b")], "expression, columns"))
def project_unique_columns(spark, d):
    return frame(spark, [(e, ",".join(unique_columns(e))) for e in ("a", "concat(a, b)", "a || '-' || b", "concat(coalesce(a), b)")], "expression string, columns string")


@query(f"SELECT unnest(['Primary key: o_orderkey', 'rows       PROD ' || lpad(a::VARCHAR, w, ' ') || '   DEV ' || lpad(b::VARCHAR, w, ' '), 'added      ' || xb, 'removed    ' || xa, 'updated    ' || u, 'unchanged  ' || (a - xa - u)]) AS line FROM (SELECT *, greatest(length(a::VARCHAR), length(b::VARCHAR))::INT AS w FROM ({_COUNTS}) c) e")
def project_summary(spark, d):
    none = {"added": [], "removed": [], "changed": []}
    return frame(spark, [(x,) for x in summary(none, _result(spark, d), ["o_orderkey"]).split("\n")], "line string")


@query(values([("postgres", "postgresql", "h"), ("snowflake", "snowflake", "acc"), ("duckdb", "duckdb", None), ("mystery", "ConnectError", None)], "adapter, driver, host"))
def project_profiles(spark, d):
    given = (
        {"type": "postgres", "host": "h", "dbname": "x", "user": "u", "pass": "p"},
        {"type": "snowflake", "account": "acc", "database": "x", "schema": "s", "warehouse": "w", "user": "u", "password": "p"},
        {"type": "duckdb", "path": "/tmp/x.db"},
        {"type": "mystery"},
    )
    rows = []
    for g in given:
        failed = raised(lambda g=g: source_of(g))
        rows.append((g["type"], failed or source_of(g)["driver"], None if failed else source_of(g).get("host")))
    return frame(spark, rows, "adapter string, driver string, host string")


@query("SELECT op, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM (SELECT '-' AS op, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 97 = 0) x")
def joindiff_skips_null_keys(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = orders.filter("o_orderkey % 97 <> 0").union(orders.limit(3).withColumn("o_orderkey", F.lit(None).cast("long")))
    a, b = (Segment(x, ("o_orderkey",), extras=("o_orderstatus",)) for x in (orders, b))
    differ = JoinDiff(a, b, skip_null_keys=True)
    assert raised(lambda: JoinDiff(a, b).validate()) == "ValueError" and differ.validate() is not None
    return differ.rows()

