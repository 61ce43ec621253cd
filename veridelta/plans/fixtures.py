"""Changed copies of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CHANGED = {
    "orders": """
SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS o_totalprice,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 100000000, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 211 = 0""",
    "conversations": """
SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 47 = 0 THEN NULL ELSE text END AS text
FROM conversations WHERE (conv_id * 31 + turn) % 53 <> 0""",
    "events": """
SELECT event_id, user_id, CASE WHEN event_id % 83 = 0 THEN concat(event_type, '_x') ELSE event_type END AS event_type,
       CASE WHEN event_id % 67 = 0 THEN NULL ELSE value END AS value
FROM events WHERE event_id % 101 <> 0""",
    "customer": """
SELECT c_name, c_acctbal, CASE WHEN c_custkey % 59 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 73 <> 0""",
    "lineitem": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 97 <> 0",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A query over the driver's tables by their names."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if f" {t} " in f" {query.replace(chr(10), ' ').replace(')', ' ')} "}
    for t, df in named.items():
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(query, **named)


def changed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, CHANGED[name])


def scratch(spark: SparkSession, name: str) -> str:
    """Name of a table of this session: what a former one left in the warehouse is not
    in the way."""
    return f"veridelta_{name}_{re.sub('[^0-9A-Za-z]', '', spark.sparkContext.applicationId)}"
