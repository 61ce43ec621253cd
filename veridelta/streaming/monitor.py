"""A continuous checksum of a growing table, for two replicas to be held together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions import checksum as C
from veridelta.functions.keyspace import hash_bucket
from veridelta.functions.logical import logical_schema
from veridelta.functions.normalize import normalize


def _texts(df: DataFrame, columns: list[str]) -> list[Column]:
    schema = logical_schema(df)
    return [normalize(F.col(f"`{c}`"), schema[c]) for c in columns]


def checksum_windows(
    df: DataFrame, keys: list[str], update_column: str, columns: list[str], window: str = "1 hour", lateness: str = "10 minutes", buckets: int = 16
) -> DataFrame:
    """window_start, bucket, n, checksum (a decimal, which can't overflow) of each window of the update column; of a
    stream, windows close when the watermark passes, and later rows are dropped."""
    stamped = df.withColumn("_at", F.col(f"`{update_column}`").cast("timestamp"))
    if df.isStreaming:
        stamped = stamped.withWatermark("_at", lateness)
    sums = stamped.groupBy(F.window("_at", window).alias("w"), hash_bucket(_texts(df, keys), buckets).alias("bucket")).agg(
        F.count("*").alias("n"), C.checksum(_texts(df, columns)).alias("checksum")
    )
    return sums.select(F.col("w.start").alias("window_start"), "bucket", "n", "checksum")


def drifted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Windows and buckets whose count or checksum differ between two monitors."""
    left = a.select("window_start", "bucket", F.col("n").alias("n_a"), F.col("checksum").alias("checksum_a"))
    right = b.select("window_start", "bucket", F.col("n").alias("n_b"), F.col("checksum").alias("checksum_b"))
    both = left.join(right, ["window_start", "bucket"], "full_outer")
    return both.filter(~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("checksum_a").eqNullSafe(F.col("checksum_b"))))
