"""Tables written, created and dropped."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def name_from_template(name: str, now: datetime | None = None) -> str:
    """``%t`` becomes the time."""
    return name.replace("%t", (now or datetime.now()).strftime("%Y-%m-%d_%H_%M_%S"))


def quoted(name: str) -> str:
    return ".".join("`" + p.strip("`").replace("`", "``") + "`" for p in name.split("."))


def create_table(spark: SparkSession, name: str, schema_or_rows: str | DataFrame, if_not_exists: bool = False) -> None:
    """An empty table of a schema, or one with a query's rows."""
    clause = "IF NOT EXISTS " if if_not_exists else ""
    if isinstance(schema_or_rows, DataFrame):
        if if_not_exists and spark.catalog.tableExists(name):
            return
        schema_or_rows.write.mode("error").saveAsTable(quoted(name))
    else:
        spark.sql(f"CREATE TABLE {clause}{quoted(name)} ({schema_or_rows}) USING parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {quoted(name)}")


def insert_rows(spark: SparkSession, name: str, rows: Iterable[tuple], columns: list[str] | None = None) -> None:
    schema = spark.table(name).schema
    names = columns or schema.names
    given = [schema[c] for c in names]
    df = spark.createDataFrame([tuple(r) for r in rows], type(schema)(given))
    insert_query(df, name)


def insert_query(df: DataFrame, name: str) -> None:
    """Append by column name; columns not given are null."""
    from pyspark.sql import functions as F

    target = df.sparkSession.table(name)
    cells = [F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]
    df.select(*cells).write.insertInto(quoted(name))


def append_to_table(df: DataFrame, name: str) -> None:
    """Append, creating the table where it is missing."""
    df.write.mode("append").saveAsTable(quoted(name))


def temp_table(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_table(df: DataFrame, name: str, limit: int | None = None) -> None:
    drop_table(df.sparkSession, name)
    (df if limit is None else df.limit(limit)).write.mode("overwrite").saveAsTable(quoted(name))


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
