"""Every query of the engine, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import checksum as C
from veridelta.functions import normalize as N
from veridelta.operators import builder as B
from veridelta.operators.align import with_precision
from veridelta.operators.hashdiff import HashDiff, diff_sets, range_checksums
from veridelta.operators.joindiff import JoinDiff
from veridelta.operators.rangediff import RangeDiff
from veridelta.operators.result import key_stats, wide_rows
from veridelta.operators.schema_diff import schema_diff_frame
from veridelta.operators.segment import Segment
from veridelta.streaming.monitor import checksum_windows

from .fixtures import CHANGED, changed, scratch, sql, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if oracle:
            _oracles[key] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# --- SQL text of the canonical strings ---------------------------------------


def _text(expr: str, kind: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,2)) AS VARCHAR)" if kind == "n" else f"CAST({expr} AS VARCHAR)" if kind == "i" else expr


#: table: (keys, columns) with their kinds (i integer, n number of two digits, s string)
SHAPES = {
    "orders": ([("o_orderkey", "i")], [("o_totalprice", "n"), ("o_orderstatus", "s")]),
    "conversations": ([("conv_id", "i"), ("turn", "i")], [("role", "s"), ("text", "s")]),
    "events": ([("event_id", "i")], [("user_id", "i"), ("event_type", "s"), ("value", "n")]),
    "customer": ([("c_name", "s")], [("c_acctbal", "n"), ("c_mktsegment", "s")]),
    "lineitem": ([("l_orderkey", "i"), ("l_linenumber", "i")], [("l_quantity", "n")]),
}


def _diff_sql(name: str, a: str | None = None, b: str | None = None, ignore: tuple[str, ...] = ()) -> str:
    """Rows of every key that isn't one equal row on both sides."""
    keys, columns = SHAPES[name]
    shown = ", ".join(f"{_text(c, k)} AS {c}" for c, k in keys + columns)
    on = ", ".join(c for c, _ in keys)
    row = "struct_pack(" + ", ".join(f"{c} := {c}" for c, _ in columns if c not in ignore) + ")"
    return f"""
WITH a AS (SELECT {shown} FROM ({a or f'SELECT * FROM {name}'}) x), b AS (SELECT {shown} FROM ({b or CHANGED[name]}) y),
u AS (SELECT '-' AS op, * FROM a UNION ALL SELECT '+' AS op, * FROM b),
w AS (SELECT *, count(*) FILTER (op = '-') OVER k AS na, count(*) FILTER (op = '+') OVER k AS nb, min({row}) OVER k AS low, max({row}) OVER k AS high
      FROM u WINDOW k AS (PARTITION BY {on}))
SELECT op, {', '.join(c for c, _ in keys + columns)} FROM w WHERE na <> 1 OR nb <> 1 OR low IS DISTINCT FROM high"""


def _pair(spark: SparkSession, d: str, name: str, **more) -> tuple[Segment, Segment]:
    keys, columns = SHAPES[name]
    out = []
    for df in (table(spark, d, name), changed(spark, d, name)):
        s = Segment(df, tuple(k for k, _ in keys), extras=tuple(c for c, _ in columns), **more)
        out.append(with_precision(s, {c: 2 for c, k in columns if k == "n"}))
    return out[0], out[1]


# --- join diff -----------------------------------------------------------------


@query(_diff_sql("orders"))
def joindiff_rows_orders(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).rows()


_WIDE = f"""
SELECT CAST(b.o_orderkey IS NULL AS INT) AS is_exclusive_a, CAST(a.o_orderkey IS NULL AS INT) AS is_exclusive_b,
       CAST(a.o_orderkey IS DISTINCT FROM b.o_orderkey AS INT) AS is_diff_o_orderkey,
       CAST(a.o_totalprice IS DISTINCT FROM b.o_totalprice AS INT) AS is_diff_o_totalprice,
       CAST(a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS INT) AS is_diff_o_orderstatus,
       CAST(a.o_orderkey AS VARCHAR) AS o_orderkey_a, CAST(b.o_orderkey AS VARCHAR) AS o_orderkey_b,
       {_text('a.o_totalprice', 'n')} AS o_totalprice_a, {_text('b.o_totalprice', 'n')} AS o_totalprice_b,
       a.o_orderstatus AS o_orderstatus_a, b.o_orderstatus AS o_orderstatus_b
FROM orders a FULL OUTER JOIN ({CHANGED['orders']}) b ON a.o_orderkey = b.o_orderkey"""
_DIFFS = f"SELECT * FROM ({_WIDE}) w WHERE is_exclusive_a = 1 OR is_exclusive_b = 1 OR is_diff_o_totalprice = 1 OR is_diff_o_orderstatus = 1"


@query(_DIFFS)
def joindiff_wide_orders(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).wide()


@query(_WIDE)
def joindiff_all_rows_orders(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).wide(all_rows=True)


@query(f"SELECT sum(is_diff_o_totalprice)::BIGINT AS o_totalprice, sum(is_diff_o_orderstatus)::BIGINT AS o_orderstatus FROM ({_DIFFS}) d")
def joindiff_diff_counts(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).diff_counts()


@query(f"SELECT count(*) AS exclusive_count FROM ({_WIDE}) d WHERE is_exclusive_a = 1 OR is_exclusive_b = 1")
def joindiff_exclusive_count(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).exclusive_count()


_SUMS = 'count(*) AS "count", CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS VARCHAR) AS sum_o_totalprice'


@query(f"SELECT 'a' AS \"table\", {_SUMS} FROM orders UNION ALL SELECT 'b', {_SUMS} FROM ({CHANGED['orders']}) b")
def joindiff_table_stats(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).table_stats()


@query(_diff_sql("conversations"))
def joindiff_compound_conversations(spark, d):
    return JoinDiff(*_pair(spark, d, "conversations")).rows()


@query(_diff_sql("events"))
def joindiff_rows_events(spark, d):
    return JoinDiff(*_pair(spark, d, "events")).rows()


@query(_diff_sql("orders"))
def joindiff_renamed_columns(spark, d):
    a, b = _pair(spark, d, "orders")
    renamed = b.df.toDF("key2", "price2", "status2")
    return JoinDiff(a, with_precision(Segment(renamed, ("key2",), extras=("price2", "status2")), {"price2": 2})).rows()


@query(
    f"""
SELECT 'diff' AS kind, o_orderkey_a AS k, o_orderstatus_a AS v1, o_orderstatus_b AS v2 FROM ({_DIFFS}) d WHERE is_exclusive_a = 0 AND is_exclusive_b = 0
UNION ALL SELECT 'exclusive1', o_orderkey_a, o_orderstatus_a, NULL FROM ({_DIFFS}) d WHERE is_exclusive_a = 1
UNION ALL SELECT 'exclusive2', o_orderkey_b, NULL, o_orderstatus_b FROM ({_DIFFS}) d WHERE is_exclusive_b = 1"""
)
def report_json(spark, d):
    differ = JoinDiff(*_pair(spark, d, "orders"))
    got = wide_rows(differ.wide(), differ.key_names, differ.names)
    at = lambda path: F.get_json_object("row", path)
    return got.select(
        "kind",
        F.coalesce(at("$.o_orderkey.dataset1"), at("$.o_orderkey.dataset2")).alias("k"),
        at("$.o_orderstatus.dataset1").alias("v1"),
        at("$.o_orderstatus.dataset2").alias("v2"),
    )


@query()
def sample_exclusive(spark, d):
    return JoinDiff(*_pair(spark, d, "orders")).sample_exclusive(10, seed=7)


@query(_DIFFS)
def materialized_diff(spark, d):
    from veridelta.sources.sinks import write_table

    differ = JoinDiff(*_pair(spark, d, "orders"))
    name = scratch(spark, "materialized_diff")
    write_table(differ.wide(), name)
    return spark.table(name)


# --- hash diff -----------------------------------------------------------------


def _hash_query(name: str):
    @query(_diff_sql(name), f"hashdiff_rows_{name}")
    def run(spark, d):
        return HashDiff(*_pair(spark, d, name)).rows()


for _name in ("orders", "conversations", "events"):
    _hash_query(_name)


@query(_diff_sql("orders"))
def rangediff_rows_orders(spark, d):
    """Bisection of the key range, down to ranges of fewer than 64 rows."""
    return RangeDiff(*_pair(spark, d, "orders"), factor=8, threshold=64).rows()


@query(_diff_sql("conversations"))
def rangediff_rows_conversations(spark, d):
    return RangeDiff(*_pair(spark, d, "conversations")).rows()


@query(_diff_sql("customer"))
def hashdiff_customer_name_key(spark, d):
    return HashDiff(*_pair(spark, d, "customer")).rows()


_UUID = (
    "concat(substr(md5(CAST(c_custkey AS {t})), 1, 8), '-', substr(md5(CAST(c_custkey AS {t})), 9, 4), '-', substr(md5(CAST(c_custkey AS {t})), 13, 4), '-',"
    " substr(md5(CAST(c_custkey AS {t})), 17, 4), '-', substr(md5(CAST(c_custkey AS {t})), 21, 12))"
)
_UUID_A = "SELECT {u} AS id, c_mktsegment FROM customer"
_UUID_B = "SELECT {u} AS id, CASE WHEN c_custkey % 59 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 73 <> 0"
SHAPES["uuid"] = ([("id", "s")], [("c_mktsegment", "s")])
_U = _UUID.format(t="VARCHAR")


@query(_diff_sql("uuid", _UUID_A.format(u=_U), _UUID_B.format(u=_U)))
def hashdiff_uuid_key(spark, d):
    u = _UUID.format(t="STRING")
    a, b = (Segment(sql(spark, d, q.format(u=u)), ("id",), extras=("c_mktsegment",)) for q in (_UUID_A, _UUID_B))
    return HashDiff(a, b, strict_keys=True).rows()


_ALNUM_A = "SELECT lpad(CAST(o_orderkey AS {t}), 12, '0') AS id, o_orderpriority FROM orders"
_ALNUM_B = "SELECT lpad(CAST(o_orderkey AS {t}), 12, '0') AS id, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0"
SHAPES["alnum"] = ([("id", "s")], [("o_orderpriority", "s")])


@query(_diff_sql("alnum", _ALNUM_A.format(t="VARCHAR"), _ALNUM_B.format(t="VARCHAR")))
def hashdiff_alphanumeric_key(spark, d):
    a, b = (Segment(sql(spark, d, q.format(t="STRING")), ("id",), extras=("o_orderpriority",)) for q in (_ALNUM_A, _ALNUM_B))
    return HashDiff(a, b, strict_keys=True).rows()


@query(_diff_sql("lineitem"))
def hashdiff_duplicate_keys_lineitem(spark, d):
    return HashDiff(*_pair(spark, d, "lineitem")).rows()


@query(_diff_sql("orders", ignore=("o_totalprice",)))
def hashdiff_ignored_column(spark, d):
    a, b = _pair(spark, d, "orders")
    return HashDiff(replace(a, ignored=frozenset({"o_totalprice"})), b).rows()


@query(_diff_sql("orders", b="SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE 1 = 0"))
def hashdiff_empty_side(spark, d):
    a, _ = _pair(spark, d, "orders")
    return HashDiff(a, replace(a, where="1 = 0")).rows()


@query(_diff_sql("orders", b="SELECT * FROM orders"))
def hashdiff_identical(spark, d):
    a, _ = _pair(spark, d, "orders")
    return HashDiff(a, a).rows()


_REDUCED_B = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,1)) AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0"
SHAPES["reduced"] = ([("o_orderkey", "i")], [("o_totalprice", "s"), ("o_orderstatus", "s")])
_R1 = "CAST(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(20,1)) AS VARCHAR)"


@query(
    _diff_sql(
        "reduced",
        f"SELECT o_orderkey, {_R1} AS o_totalprice, o_orderstatus FROM orders",
        f"SELECT o_orderkey, {_R1} AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0",
    )
)
def hashdiff_mutual_precision(spark, d):
    a = sql(spark, d, "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS o_totalprice, o_orderstatus FROM orders")
    b = sql(spark, d, "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(20,1)) AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0")
    return HashDiff(*(Segment(x, ("o_orderkey",), extras=("o_totalprice", "o_orderstatus")) for x in (a, b))).rows()


@query(
    f"SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM ({CHANGED['orders']}) b) AS rows_b, 1 AS differs, 0 AS equal_differs",
    "hashdiff_bucket_agreement",
)
def _bucket_agreement(spark, d):
    """Totals over the buckets; of a table with itself none may differ."""
    a, b = _pair(spark, d, "orders")
    flag = F.max(F.col("is_diff").cast("int"))
    same = HashDiff(a, a, buckets=64).summary().agg(flag.alias("equal_differs"))
    return HashDiff(a, b, buckets=64).summary().agg(F.sum("count_a").alias("rows_a"), F.sum("count_b").alias("rows_b"), flag.alias("differs")).join(same)


_CLASH_A = 'SELECT o_orderkey AS {q}_na{q}, o_orderstatus AS bucket, o_orderpriority AS op, o_custkey AS {q}_op{q}, o_orderstatus AS {q}_low{q} FROM orders'
_CLASH_B = "SELECT o_orderkey AS {q}_na{q}, CASE WHEN o_orderkey % 89 = 0 THEN 'x' ELSE o_orderstatus END AS bucket, o_orderpriority AS op, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS {q}_op{q}, o_orderstatus AS {q}_low{q} FROM orders WHERE o_orderkey % 101 <> 0"
SHAPES["clash"] = ([("_na", "i")], [("bucket", "s"), ("op", "s"), ("_op", "s"), ("_low", "s")])


@query(
    f"""
WITH u AS (SELECT '-' AS op_, * FROM ({_CLASH_A.format(q='"')}) a UNION ALL SELECT '+', * FROM ({_CLASH_B.format(q='"')}) b),
w AS (SELECT *, count(*) OVER k AS n, min(struct_pack(bucket, op, _op, _low)) OVER k AS lo, max(struct_pack(bucket, op, _op, _low)) OVER k AS hi FROM u WINDOW k AS (PARTITION BY _na))
SELECT op_, CAST(_na AS VARCHAR) AS _na, bucket, op, CAST(_op AS VARCHAR) AS _op, _low FROM w WHERE n <> 2 OR lo IS DISTINCT FROM hi"""
)
def hashdiff_clashing_columns(spark, d):
    """Columns named like the engine's own; the sign column makes room."""
    a, b = _clash(spark, d)
    return HashDiff(a, b).rows()


def _clash(spark, d):
    keys, columns = SHAPES["clash"]
    frames = (sql(spark, d, q.format(q="`")) for q in (_CLASH_A, _CLASH_B))
    return [Segment(df, ("_na",), extras=tuple(c for c, _ in columns)) for df in frames]


@query(_oracles["hashdiff_clashing_columns"])
def joindiff_clashing_columns(spark, d):
    return JoinDiff(*_clash(spark, d)).rows()


# --- checksums, ranges, segments --------------------------------------------------

_RANGE = """
WITH m AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) + 1 AS hi FROM orders),
p AS (SELECT lo + (hi - lo) * i // 32 AS p FROM m, (SELECT unnest(generate_series(1, 31)) AS i)),
o AS (SELECT o_orderkey, concat(CAST(o_orderkey AS VARCHAR), '|', CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR)) AS s FROM orders)
SELECT (SELECT count(*) FROM p WHERE o.o_orderkey >= p.p)::INT AS segment_id, count(*) AS n,
       sum(('0x' || substr(md5(s), 21, 12))::BIGINT - 140737488355327)::BIGINT AS checksum
FROM o GROUP BY 1"""


@query(_RANGE)
def segment_checksum_range(spark, d):
    s = Segment(table(spark, d, "orders"), ("o_orderkey",), extras=("o_totalprice",))
    return range_checksums(with_precision(s, {"o_totalprice": 2}), 32).withColumn("checksum", F.col("checksum").cast("long"))


_SEG = "sum(('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), '|', coalesce(o_orderstatus, '<null>'))), 21, 12))::BIGINT - 140737488355327)::BIGINT"


@query(
    f"""
SELECT coalesce(a.g, b.g) AS segment, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.s AS checksum_a, b.s AS checksum_b
FROM (SELECT o_orderkey % 64 AS g, count(*) AS n, {_SEG} AS s FROM orders GROUP BY 1) a
FULL OUTER JOIN (SELECT o_orderkey % 64 AS g, count(*) AS n, {_SEG} AS s FROM ({CHANGED['orders']}) x GROUP BY 1) b ON a.g = b.g
WHERE a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s"""
)
def segment_mismatch(spark, d):
    def sums(df, tag):
        texts = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus")]
        return df.groupBy((F.col("o_orderkey") % 64).alias("segment")).agg(F.count("*").alias(f"n_{tag}"), C.checksum(texts).cast("long").alias(f"checksum_{tag}"))

    both = sums(table(spark, d, "orders"), "a").join(sums(changed(spark, d, "orders"), "b"), "segment", "full_outer")
    odd = ~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("checksum_a").eqNullSafe(F.col("checksum_b")))
    return both.filter(odd).select("segment", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")), "checksum_a", "checksum_b")


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(o_orderpriority), 21, 12))::BIGINT - 140737488355327)::BIGINT AS checksum FROM orders")
def count_and_checksum(spark, d):
    """The checksum is a long, as the SQL has it, unless no long holds it: hashes of a few
    values don't cancel out, and from some 137,000 orders on the sum is a decimal."""
    n, total = Segment(table(spark, d, "orders"), ("o_orderpriority",)).count_and_checksum()
    if total is None or -(1 << 63) <= total < 1 << 63:
        return spark.createDataFrame([(n, total)], "n long, checksum long")
    return spark.createDataFrame([(n, Decimal(total))], "n long, checksum decimal(38,0)")


@query("SELECT min(conv_id) AS min_conv_id, max(conv_id) AS max_conv_id, min(turn) AS min_turn, max(turn) AS max_turn FROM conversations")
def key_range(spark, d):
    low, high = Segment(table(spark, d, "conversations"), ("conv_id", "turn")).key_range()
    return spark.createDataFrame([(low.parts[0], high.parts[0], low.parts[1], high.parts[1])], "min_conv_id long, max_conv_id long, min_turn long, max_turn long")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000")
def key_window_filter(spark, d):
    from veridelta.functions.keyspace import Vector

    s = Segment(table(spark, d, "orders"), ("o_orderkey",), min_key=Vector((100,)), max_key=Vector((2000,)))
    return s.rows().select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def update_window_filter(spark, d):
    from datetime import datetime

    s = Segment(table(spark, d, "orders"), ("o_orderkey",), "o_orderdate", min_update=datetime(1995, 1, 1), max_update=datetime(1996, 1, 1))
    return s.rows().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000)")
def where_filter(spark, d):
    return Segment(table(spark, d, "orders"), ("o_orderkey",), where="o_orderstatus = 'F' OR o_totalprice > 100000").rows().select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    a, b = _pair(spark, d, "lineitem")
    return JoinDiff(a, b).duplicate_keys()


@query("SELECT CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey END AS k, o_orderstatus FROM orders WHERE o_orderkey % 41 = 0")
def null_keys(spark, d):
    df = sql(spark, d, "SELECT CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey END AS k, o_orderstatus FROM orders")
    s = Segment(df, ("k",), extras=("o_orderstatus",))
    return JoinDiff(s, s).null_keys()


# --- normalisation ------------------------------------------------------------------


@query(
    "SELECT event_id, CAST(CAST(value AS DECIMAL(38,2)) AS VARCHAR) AS v2, CAST(CAST(value AS DECIMAL(38,1)) AS VARCHAR) AS v1, CAST(user_id AS VARCHAR) AS u FROM events"
)
def normalize_numbers(spark, d):
    return table(spark, d, "events").select("event_id", N.number_text(F.col("value"), 2, True).alias("v2"), N.number_text(F.col("value"), 1, True).alias("v1"), F.col("user_id").cast("string").alias("u"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM events")
def normalize_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", N.timestamp_text(F.col("ts")).alias("t"))


@query(
    """SELECT event_id, strftime(make_timestamp((epoch_us(x) + 500) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS rounded,
       strftime(make_timestamp(epoch_us(x) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS cut
FROM (SELECT event_id, ts + to_microseconds(event_id * 7919 % 1000000) AS x FROM events) e"""
)
def normalize_timestamps_ms_round(spark, d):
    moved = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 7919 % 1000000)
    return table(spark, d, "events").select("event_id", N.timestamp_text(moved, 3, True).alias("rounded"), N.timestamp_text(moved, 3, False).alias("cut"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d FROM orders")
def normalize_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.date_text(F.col("o_orderdate").cast("date")).alias("d"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS t FROM events")
def normalize_times(spark, d):
    return table(spark, d, "events").select("event_id", N.time_text(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("t"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS b, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS n FROM customer")
def normalize_booleans(spark, d):
    positive = F.col("c_acctbal") > 0
    return table(spark, d, "customer").select("c_custkey", N.boolean_text(positive).alias("b"), N.boolean_text(F.when(F.col("c_custkey") % 7 != 0, positive)).alias("n"))


@query(f"SELECT c_custkey, trim(concat(' ', {_U}, ' ')) AS u FROM customer")
def normalize_uuid(spark, d):
    return sql(spark, d, f"SELECT c_custkey, concat(' ', {_UUID.format(t='STRING')}, ' ') AS u FROM customer").select("c_custkey", N.uuid_text(F.col("u")).alias("u"))


@query("SELECT vec_id, concat('[', CAST(label AS VARCHAR), ',', CAST(vec_id AS VARCHAR), ',null]') AS a FROM embeddings")
def normalize_arrays(spark, d):
    a = F.array(F.col("label").cast("long"), F.col("vec_id"), F.lit(None).cast("long"))
    return table(spark, d, "embeddings").select("vec_id", N.complex_text(a).alias("a"))


@query("SELECT n_nationkey, concat('{\"k\":', CAST(n_nationkey AS VARCHAR), ',\"r\":', coalesce(CAST(nullif(n_regionkey, 2) AS VARCHAR), 'null'), '}') AS s FROM nation")
def normalize_structs(spark, d):
    s = F.struct(F.col("n_nationkey").alias("k"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("r"))
    return table(spark, d, "nation").select("n_nationkey", N.complex_text(s).alias("s"))


@query("SELECT o_orderkey, ('0x' || substr(md5(o_orderpriority), 21, 12))::BIGINT - 140737488355327 AS i, md5(o_orderpriority) AS h FROM orders")
def md5_functions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.md5_as_int(F.col("o_orderpriority")).alias("i"), C.md5_as_hex(F.col("o_orderpriority")).alias("h"))


@query("SELECT conv_id, turn, concat(coalesce(role, '<null>'), '|', coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS VARCHAR) END, '<null>')) AS c FROM conversations")
def concat_nulls(spark, d):
    turn = F.when(F.col("turn") % 3 != 0, F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", C.joined_text([F.col("role"), turn]).alias("c"))


@query("SELECT '-' AS op, CAST(event_id AS VARCHAR) AS event_id, props FROM events WHERE event_id % 97 = 0")
def json_equiv_suppressed(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "props")
    b = a.filter("event_id % 97 <> 0").withColumn("props", F.replace("props", F.lit(": "), F.lit(":")))
    return diff_sets(a, b, ["event_id"], json_columns=frozenset({"props"}))


# --- statistics -------------------------------------------------------------------------

_FLAGS = f"SELECT max(CAST(op = '-' AS INT)) AS m, max(CAST(op = '+' AS INT)) AS p FROM ({_diff_sql('orders')}) r GROUP BY o_orderkey"
_KEYS = "count(*) FILTER (m = 1 AND p = 0) AS exclusive_a, count(*) FILTER (m = 0 AND p = 1) AS exclusive_b, count(*) FILTER (m = 1 AND p = 1) AS updated"


@query(f"SELECT {_KEYS} FROM ({_FLAGS}) f")
def diff_stats(spark, d):
    return key_stats(HashDiff(*_pair(spark, d, "orders")).rows(), ["o_orderkey"])


@query(
    f"""SELECT count(*) AS total_rows, count(*) FILTER (is_exclusive_a = 0 AND is_exclusive_b = 0 AND is_diff_o_totalprice = 0 AND is_diff_o_orderstatus = 0) AS unchanged,
       count(*) FILTER (is_exclusive_a = 0 AND is_exclusive_b = 0 AND is_diff_o_totalprice = 1) AS o_totalprice,
       count(*) FILTER (is_exclusive_a = 0 AND is_exclusive_b = 0 AND is_diff_o_orderstatus = 1) AS o_orderstatus FROM ({_WIDE}) w"""
)
def diff_stats_by_column(spark, d):
    both = "is_exclusive_a = 0 and is_exclusive_b = 0"
    return JoinDiff(*_pair(spark, d, "orders")).joined.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.expr(f"{both} and is_diff_o_totalprice = 0 and is_diff_o_orderstatus = 0")).alias("unchanged"),
        F.count_if(F.expr(f"{both} and is_diff_o_totalprice = 1")).alias("o_totalprice"),
        F.count_if(F.expr(f"{both} and is_diff_o_orderstatus = 1")).alias("o_orderstatus"),
    )


@query("SELECT * FROM (VALUES ('s_acctbal', 'removed', 'double', NULL), ('s_new', 'added', NULL, 'int'), ('s_nationkey', 'type', 'int', 'bigint')) v(column_name, change, type_a, type_b)")
def schema_diff(spark, d):
    a = table(spark, d, "supplier")
    return schema_diff_frame(a, a.drop("s_acctbal").withColumn("s_new", F.lit(1)).withColumn("s_nationkey", F.col("s_nationkey").cast("long")))


# --- relational builder --------------------------------------------------------------------

t = B.this


def _rel(name: str, oracle: str | None):
    """Register a builder query: ``f(load)`` gives a relation."""

    def add(f):
        @query(oracle, name)
        def run(spark, d):
            return f(lambda x: B.table(table(spark, d, x))).df

        return f

    return add


_rel("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(
    lambda r: r("customer").select(k=t.c_nationkey).union(r("supplier").select(k=t.s_nationkey))
)
_rel("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(
    lambda r: r("customer").select(k=t.c_nationkey).union_all(r("supplier").select(k=t.s_nationkey))
)
_rel("set_minus", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")(
    lambda r: r("orders").select(k=t.o_custkey).minus(r("customer").where(t.c_custkey % 3 == 0).select(k=t.c_custkey))
)
_rel("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")(
    lambda r: r("orders").select(k=t.o_custkey).intersect(r("customer").where(t.c_custkey % 3 == 0).select(k=t.c_custkey))
)


def _on():
    return t.c_nationkey == t.n_nationkey


_rel("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(
    lambda r: B.join(r("customer"), r("nation")).on(_on()).select(t.c_custkey, t.n_name)
)
_rel("join_three", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda r: B.join(r("customer"), r("nation"), r("region")).on(_on(), t.n_regionkey == t.r_regionkey).select(t.c_custkey, t.n_name, t.r_name)
)
_few = "(SELECT * FROM nation WHERE n_nationkey < 12)"
_rel("join_left", f"SELECT c_custkey, n_name FROM customer LEFT JOIN {_few} n ON c_nationkey = n_nationkey")(
    lambda r: B.leftjoin(r("customer"), r("nation").where(t.n_nationkey < 12)).on(_on()).select(t.c_custkey, t.n_name)
)
_rel("join_right", f"SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_nationkey < 5) c RIGHT JOIN {_few} n ON c_nationkey = n_nationkey")(
    lambda r: B.rightjoin(r("customer").where(t.c_nationkey < 5), r("nation").where(t.n_nationkey < 12)).on(_on()).select(t.c_custkey, t.n_name)
)
_rel("join_full", f"SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_nationkey > 5) c FULL OUTER JOIN {_few} n ON c_nationkey = n_nationkey")(
    lambda r: B.outerjoin(r("customer").where(t.c_nationkey > 5), r("nation").where(t.n_nationkey < 12)).on(_on()).select(t.c_custkey, t.n_name)
)
_rel("join_theta", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey AND n_nationkey > 3")(
    lambda r: B.join(r("region"), r("nation")).on(t.r_regionkey < t.n_regionkey, t.n_nationkey > 3).select(t.r_regionkey, t.n_nationkey)
)
_rel("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")(lambda r: B.join(r("region"), r("nation")).select(t.r_name, t.n_name))
_rel("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(
    lambda r: r("customer").exists(r("orders").where(t.o_orderstatus == "F"), t.o_custkey == t.c_custkey).select(t.c_custkey)
)


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({CHANGED['orders']}) b)")
def anti_exclusive(spark, d):
    return table(spark, d, "orders").join(changed(spark, d, "orders"), "o_orderkey", "left_anti").select("o_orderkey")


@query(f"SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_nationkey > 5) c FULL OUTER JOIN {_few} n ON c_nationkey = n_nationkey")
def mysql_style_outer(spark, d):
    """A full outer join as a left join and what only the right side has."""
    c = B.table(table(spark, d, "customer")).where(t.c_nationkey > 5)
    n = B.table(table(spark, d, "nation")).where(t.n_nationkey < 12)
    left = B.leftjoin(c, n).on(_on()).select(t.c_custkey, t.n_name)
    return left.union_all(n.not_exists(c, _on()).select(B.code("cast(null as bigint)").alias("c_custkey"), t.n_name)).df


_rel("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) > 8")(
    lambda r: r("orders").group_by(t.o_custkey).agg(n=B.count("*"), m=B.max_("o_totalprice")).having(t.n > 8)
)
_rel("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")(
    lambda r: r("orders").group_by(t.o_orderstatus).agg(n=B.count_distinct("o_custkey"))
)
_rel("agg_basic", "SELECT count(*) AS n, count(o_orderstatus) AS k, min(o_orderkey) AS lo, max(o_orderkey) AS hi, sum(o_custkey)::BIGINT AS s, avg(o_custkey) AS a FROM orders")(
    lambda r: B.Relation(
        r("orders").df.agg(
            B.count("*").alias("n"), B.count("o_orderstatus").alias("k"), B.min_("o_orderkey").alias("lo"), B.max_("o_orderkey").alias("hi"), B.sum_("o_custkey").alias("s"), B.avg("o_custkey").alias("a")
        )
    )
)
_rel("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders")(
    lambda r: r("orders").select(t.o_orderkey, size=B.when(t.o_totalprice > 200000).then("big").when(t.o_totalprice > 50000).then("mid").else_("small"))
)
_rel("if_else", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 END AS f, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g FROM orders")(
    lambda r: r("orders").select(t.o_orderkey, f=B.if_(t.o_orderstatus == "F", 1), g=B.bool_to_int(t.o_orderstatus == "F"))
)
_rel("coalesce_nulls", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN NULL ELSE role END, 'none') AS role FROM conversations")(
    lambda r: r("conversations").select(t.conv_id, t.turn, role=B.coalesce(B.if_(t.turn % 2 == 0, None, t.role), B.code("'none'")))
)
_rel("in_like", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9) AND p_type LIKE '%S%'")(
    lambda r: r("part").where(B.in_(t.p_size, [1, 5, 9]), t.p_type.like("%S%")).select(t.p_partkey, t.p_brand)
)
_rel("is_distinct_from", "SELECT event_id FROM events WHERE CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END IS DISTINCT FROM 'click'")(
    lambda r: r("events").where(B.is_distinct_from(B.if_(t.event_id % 5 == 0, None, t.event_type), "click")).select(t.event_id)
)
_rel("null_equals", "SELECT event_id FROM events WHERE CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END IS NULL")(
    lambda r: r("events").where(B.equals(B.if_(t.event_id % 5 == 0, None, t.event_type), None)).select(t.event_id)
)
_rel("and_or", "SELECT o_orderkey FROM orders WHERE (o_orderkey < 50 OR o_orderkey > 14000 OR o_orderstatus = 'P') AND o_orderpriority <> '1-URGENT'")(
    lambda r: r("orders").where(B.or_(t.o_orderkey < 50, t.o_orderkey > 14000, t.o_orderstatus == "P"), t.o_orderpriority != "1-URGENT", B.SKIP).select(t.o_orderkey)
)
_rel("arithmetic", "SELECT o_orderkey, -o_custkey AS neg, o_custkey + o_orderkey AS plus, o_custkey - o_orderkey AS minus FROM orders")(
    lambda r: r("orders").select(t.o_orderkey, neg=-t.o_custkey, plus=t.o_custkey + t.o_orderkey, minus=t.o_custkey - t.o_orderkey)
)
_rel("cast_func", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, upper(o_orderpriority) AS u, length(o_orderpriority)::INT AS n FROM orders")(
    lambda r: r("orders").select(t.o_orderkey, s=t.o_orderkey.cast("string"), u=B.func("upper", t.o_orderpriority), n=B.code("length({c})", c="o_orderpriority"))
)
_rel("cte_nested", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b(k2, n2) AS (SELECT * FROM a WHERE n > 40) SELECT k2, n2 FROM b WHERE k2 > 3")(
    lambda r: r("customer").group_by(k=t.c_nationkey).agg(n=B.count("*")).where(t.n > 40).cte("k2", "n2").where(t.k2 > 3)
)
_rel("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")(lambda r: r("customer").select(t[["c_mktsegment", "c_nationkey"]], distinct=True))
_rel("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")(
    lambda r: r("orders").select(t.o_orderkey, t.o_totalprice).order_by(t.o_totalprice, t.o_orderkey).limit(25)
)
_rel("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")(
    lambda r: r("orders").where(t.o_orderkey > 500).order_by(t.o_orderkey).limit(40).select(t.o_orderkey)
)
_rel("random_sample", None)(lambda r: r("orders").sample(10, seed=3))
_rel("self_join_alias", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda r: B.Relation(
        r("nation").alias("a").df.join(r("nation").alias("b").df, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))
    )
)


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(id, s)")
def constant_table(spark, d):
    from veridelta.sources.sinks import constant_table as make

    return make(spark, [(1, "a"), (2, None)], "id int, s string")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 7000000001, 'new'")
def insert_round_trip(spark, d):
    from veridelta.sources import sinks

    name = scratch(spark, "insert_round_trip")
    sinks.drop_table(spark, name)
    sinks.create_table(spark, name, "o_orderkey BIGINT, o_orderstatus STRING")
    sinks.insert_query(table(spark, d, "orders").filter("o_orderkey % 97 = 0"), name)
    sinks.insert_rows(spark, name, [(7000000001, "new")])
    return spark.table(name)


@query("SELECT s_suppkey, s_name FROM supplier")
def connect_parquet(spark, d):
    from veridelta.sources.connect import connect

    return connect(spark, {"driver": "parquet", "path": d}).table("supplier.parquet").select("s_suppkey", "s_name")


_EVENT = "('0x' || substr(md5(concat(CAST(event_id AS VARCHAR), '|', coalesce(event_type, '<null>'))), 21, 12))::BIGINT - 140737488355327"


@query(f"SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, sum({_EVENT})::BIGINT AS checksum FROM events GROUP BY 1")
def checksum_monitor(spark, d):
    """Batch form of the monitor: counts and checksums of its windows over all buckets."""
    got = checksum_windows(table(spark, d, "events"), ["event_id"], "ts", ["event_id", "event_type"])
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return got.groupBy(start).agg(F.sum("n").alias("n"), F.sum("checksum").cast("long").alias("checksum"))
