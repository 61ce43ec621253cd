"""Source addresses to DataFrames.

``connect("postgresql://user:pw@host/db")`` gives a database whose tables Spark
reads over JDBC; ``parquet:///folder``, ``csv://``, ``json://``, ``orc://`` read
files and ``spark://`` the session's catalog.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit
from weakref import WeakValueDictionary

from pyspark.sql import DataFrame, SparkSession

from veridelta.errors import ConnectError
from veridelta.operators.segment import Segment

FILES = {"parquet", "csv", "json", "orc"}


@dataclass(frozen=True)
class Dialect:
    """How an address becomes a JDBC url. ``path``: the parts of the path, a ``?``
    ends an optional one; ``needs``: parameters that must be given."""

    driver: str
    url: str
    path: tuple[str, ...] = ("database",)
    port: int | None = None
    needs: tuple[str, ...] = ()
    bounds: bool = True


DIALECTS = {
    "postgresql": Dialect("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", port=5432),
    "redshift": Dialect("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", port=5439),
    "mysql": Dialect("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", port=3306),
    "oracle": Dialect("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", ("database?",), 1521),
    "mssql": Dialect("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", ("database", "schema"), 1433),
    "snowflake": Dialect("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}.snowflakecomputing.com/?db={database}&schema={schema}", ("database", "schema"), None, ("warehouse",)),
    "bigquery": Dialect("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={host};DefaultDataset={dataset}", ("dataset",)),
    "presto": Dialect("com.facebook.presto.jdbc.PrestoDriver", "jdbc:presto://{host}:{port}/{catalog}/{schema}", ("catalog", "schema"), 8080),
    "trino": Dialect("io.trino.jdbc.TrinoDriver", "jdbc:trino://{host}:{port}/{catalog}/{schema}", ("catalog", "schema"), 8080),
    "databricks": Dialect("com.databricks.client.jdbc.Driver", "jdbc:databricks://{host}:443;httpPath=/{path};ConnCatalog={catalog};ConnSchema={schema}", ("path*",), None, ("catalog", "schema")),
    "clickhouse": Dialect("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}", ("database?",), 8123),
    "vertica": Dialect("com.vertica.jdbc.Driver", "jdbc:vertica://{host}:{port}/{database}", ("database?",), 5433),
    "duckdb": Dialect("org.duckdb.DuckDBDriver", "jdbc:duckdb:{file}", ("file*",)),
}


def match_path(pattern: tuple[str, ...], text: str) -> dict[str, str]:
    """Values of the path's parts: ``name`` is required, ``name?`` optional, ``name*``
    takes all that is left."""
    parts, out = [unquote(p) for p in text.strip("/").split("/") if p], {}
    for i, name in enumerate(pattern):
        if name.endswith("*"):
            out[name[:-1]] = "/".join(parts)
            parts = []
        elif parts:
            out[name.rstrip("?")] = parts.pop(0)
        elif name.endswith("?"):
            out[name[:-1]] = ""
        else:
            raise ConnectError(f"the address lacks its {name} (part {i + 1} of the path)")
    if parts:
        raise ConnectError(f"the address has too many parts: {'/'.join(parts)}")
    return out


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@dataclass
class Source:
    """Something with tables. The session, and so the connection, is the caller's."""

    spark: SparkSession
    kind: str
    options: dict[str, str] = field(default_factory=dict)
    root: str = ""
    is_closed: bool = False

    def table(self, name: str, **partitioning: Any) -> DataFrame:
        """A table or, in parentheses, a query that the source runs itself.

        ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` split
        a JDBC read over executors."""
        if self.kind in FILES:
            return self.spark.read.format(self.kind).options(**self.options).load(f"{self.root.rstrip('/')}/{name}" if self.root else name)
        if self.kind == "spark":
            return self.spark.table(name)
        which = {"query": name.strip()[1:-1]} if name.strip().startswith("(") else {"dbtable": name}
        return self.spark.read.format("jdbc").options(**self.options, **which, **{k: str(v) for k, v in partitioning.items()}).load()

    def has_table(self, name: str) -> bool:
        if self.kind == "spark":
            return self.spark.catalog.tableExists(name)
        try:
            self.table(name).schema
        except Exception as e:  # the sources word it differently
            if re.search("not exist|not found|no such|PATH_NOT_FOUND|invalid object", str(e), re.I):
                return False
            raise
        return True

    def schema(self, name: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.table(name).schema}

    def unique_columns(self, name: str) -> list[str]:
        """Columns of declared keys, where the source tells them."""
        if self.kind not in ("postgresql", "mysql", "redshift"):
            return []
        *schema, table = name.replace('"', "").replace("`", "").split(".")
        test = f"table_name = {_sql_text(table)}" + (f" AND table_schema = {_sql_text(schema[-1])}" if schema else "")
        rows = self.table(f"(SELECT column_name FROM information_schema.key_column_usage WHERE {test})").collect()
        return [r[0] for r in rows]

    def close(self) -> None:
        self.is_closed = True

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Connect:
    """Opens sources; equal addresses in one session give the same object, which is
    how a comparison knows that both tables lie in one place."""

    def __init__(self, *schemes: str):
        self.schemes = set(schemes) or {*DIALECTS, *FILES, "spark", "postgres", "toml"}
        self._open: WeakValueDictionary = WeakValueDictionary()

    def for_databases(self, *schemes: str) -> Connect:
        return Connect(*schemes)

    def __call__(self, spark: SparkSession, address: str | dict, shared: bool = True) -> Source:
        key = (id(spark), repr(sorted(address.items())) if isinstance(address, dict) else address)
        if shared and key in self._open and not self._open[key].is_closed:
            return self._open[key]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        out = self._by_dict(spark, dict(address)) if isinstance(address, dict) else self._by_uri(spark, address)
        if shared:
            self._open[key] = out
        return out

    def _known(self, scheme: str) -> str:
        scheme = {"postgres": "postgresql", "motherduck": "duckdb"}.get(scheme, scheme)
        if scheme not in self.schemes:
            raise ConnectError(f"no source for {scheme!r}; known: {', '.join(sorted(self.schemes))}")
        return scheme

    def _by_uri(self, spark: SparkSession, uri: str) -> Source:
        got = urlsplit(uri)
        scheme = got.scheme
        if "+" in scheme:
            raise ConnectError("an address has one scheme")
        scheme = self._known(scheme)
        query = parse_qsl(got.query, keep_blank_values=True)
        params = dict(query)
        if len(params) != len(query):
            raise ConnectError("a parameter is given twice")
        if scheme == "toml":
            with open(got.netloc + got.path, "rb") as f:
                whole = tomllib.load(f)
            if got.fragment not in whole.get("database", {}):
                raise ConnectError(f"no database {got.fragment!r} in {got.path}")
            return self._by_dict(spark, whole["database"][got.fragment])
        if scheme in FILES:
            return Source(spark, scheme, params, got.netloc + got.path)
        if scheme == "spark":
            return Source(spark, scheme)
        d = DIALECTS[scheme]
        # A file's path stays as it is: with its leading slash it is absolute.
        values = {"file": unquote(got.netloc + got.path)} if scheme == "duckdb" else match_path(d.path, got.path)
        for k in values:
            if k in params:
                raise ConnectError(f"{k} is given twice")
        if lack := [k for k in d.needs if k not in params]:
            raise ConnectError(f"the address lacks {', '.join(lack)}")
        values |= params | {"host": got.hostname or "", "port": str(got.port or d.port or "")}
        return self._jdbc(spark, scheme, values, unquote(got.username or ""), unquote(got.password or ""), params)

    def _by_dict(self, spark: SparkSession, conf: dict) -> Source:
        if "driver" not in conf:
            raise ConnectError("a source needs its driver")
        scheme = self._known(str(conf.pop("driver")))
        if scheme in FILES:
            return Source(spark, scheme, {k: str(v) for k, v in conf.items() if k != "path"}, str(conf.get("path", "")))
        if scheme == "spark":
            return Source(spark, scheme)
        d = DIALECTS[scheme]
        values = {"host": "", "port": str(d.port or "")} | {p.rstrip("?*"): "" for p in d.path} | {k: str(v) for k, v in conf.items()}
        if lack := [k for k in d.needs if not values.get(k)]:
            raise ConnectError(f"the source lacks {', '.join(lack)}")
        from veridelta.dbt_profile import OPTIONS

        return self._jdbc(spark, scheme, values, values.get("user", ""), values.get("password", ""), {k: v for k, v in values.items() if k in OPTIONS})

    @staticmethod
    def _jdbc(spark: SparkSession, scheme: str, values: dict, user: str, password: str, params: dict) -> Source:
        d = DIALECTS[scheme]
        options = {"url": d.url.format_map(values), "driver": d.driver, "fetchsize": "10000", "pushDownAggregate": "true"} | params
        options |= {k: v for k, v in (("user", user), ("password", password)) if v}
        return Source(spark, scheme, options)


connect = Connect()


def connect_to_table(spark: SparkSession, address: str | dict, name: str, keys=("id",), **options: Any) -> Segment:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    return Segment(connect(spark, address).table(name), keys, **options)


def redacted(address: Any) -> Any:
    """The same without passwords."""
    if isinstance(address, dict):
        return {k: "***" if re.search("password|secret|token|key$", str(k), re.I) and isinstance(v, str) else redacted(v) for k, v in address.items()}
    if isinstance(address, str):
        return re.sub(r"(?<=://)([^:/@\s]*):([^@/\s]*)@", r"\1:***@", address)
    return address
