"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the ASCII white space that separates words.
WS = r"\x20\x09-\x0D"
WORD = f"[^{WS}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of keys that may be sent to every executor, and rows of some 100 bytes.
BROADCAST_BYTES, BROADCAST_ROWS = 16_000_000, 100_000
#: A key with over 1/HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of
#: them at any size, which bounds what is broadcast.
HOT_SHARE, HOT_ROWS = 1000, 64
#: Rows of one Arrow batch: long texts must not add up in a Python worker.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder and keep Arrow batches small.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (local tests) a temporary folder is used, until the process ends. The
    batch size is the session's from then on: it holds for what runs later.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="checkpoints-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder (never on executors' disks)."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, and faster, for texts in
    which it changes no other character."""
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.length(text) == F.octet_length(text)) | (F.lower(rest) == rest)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def without(docs: DataFrame, losers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``losers`` (null-safe).

    The losers are broadcast only while the bytes of their keys fit
    ``BROADCAST_BYTES``; beyond, a shuffled anti join does it.
    """
    losers = checkpoint(losers.select(*(F.col(k).alias(f"_vd_lose_{k}") for k in keys)).distinct())
    size = sum((F.octet_length(c) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in losers.dtypes), F.lit(0))
    if (losers.agg(F.sum(F.coalesce(size, F.lit(32)))).first()[0] or 0) <= BROADCAST_BYTES:
        losers = F.broadcast(losers)
    return docs.join(losers, _equal(keys, "_vd_lose_"), "left_anti")


def _equal(keys: dict[str, Column], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (column.eqNullSafe(F.col(f"{prefix}{name}")) for name, column in keys.items()))


def one_each(docs: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` with one of the rows that share keys named in ``repeated``: the one whose
    JSON has the least SHA-256, so rows equal in all columns are one."""
    repeated = checkpoint(repeated.select(*keys))
    if repeated.isEmpty():
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = docs.join(repeated.select(*(F.col(k).alias(f"_vd_again_{k}") for k in keys)), _equal(keys, "_vd_again_"), "left_semi")
    key = F.struct(*(c.alias(k) for k, c in keys.items()))
    least = again.select(key.alias("_vd_key"), row.alias("_vd_row")).groupBy("_vd_key")
    one = least.agg(F.min_by("_vd_row", F.sha2(F.to_json("_vd_row"), 256)).alias("_vd_row")).select("_vd_row.*")
    return without(docs, repeated, keys).unionByName(one)


def spread_join(left: DataFrame, right: DataFrame, on: str, count: str, rows: int, salt: str) -> DataFrame:
    """Left join with ``right``, which has one row for each key ``on`` and in ``count``
    how many of the ``rows`` rows of ``left`` have it. Hot keys are answered by a
    broadcast of the few, and their rows spread by the column ``salt``."""
    values = F.struct(*(F.col(c) for c in right.columns if c not in (on, count)))
    is_hot = (F.col(count) > HOT_ROWS) & (F.col(count) * HOT_SHARE > rows)
    hot = right.filter(is_hot).select(on, values.alias("_vd_hot"))
    cold = right.select(on, values.alias("_vd_cold"), F.lit(0).cast("long").alias("_vd_s"))
    spread = F.when(F.col("_vd_hot").isNotNull(), F.pmod(F.xxhash64(salt, F.spark_partition_id()), F.lit(1 << 20)) + 1).otherwise(0)
    out = left.join(F.broadcast(hot), on, "left").withColumn("_vd_s", spread.cast("long")).join(cold, [on, "_vd_s"], "left")
    return out.select(*left.columns, F.coalesce("_vd_hot", "_vd_cold").alias("_vd_value")).select(*left.columns, "_vd_value.*")


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
