"""Exact dedup by skew-safe combining (built-in functions only).

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Copies are combined in each map task first (partial aggregation keyed by digest,
salt and the whole text), then per salted digest group, then the few salt
winners of hot groups globally. The whole text is a grouping key at every
stage, so equal digests alone never merge two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, checkpoint, lower_az, one_each, text_of, without

SALTS = 32


def _identified(docs: DataFrame) -> DataFrame:
    text = lower_az(text_of())
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_t")).select(
        "_id", "_t", F.unhex(F.sha2(F.col("_t"), 256)).alias("_d")
    )


def digests(docs: DataFrame) -> DataFrame:
    """One small row per document: id, SHA-256, and the second pointer (64-bit
    hash and length) that tells texts of one digest apart."""
    return checkpoint(
        _identified(docs).select("_id", "_d", F.xxhash64("_t").alias("_x"), F.length("_t").alias("_l"))
    )


def _hot(sized: DataFrame, rows: int) -> DataFrame:
    return sized.filter((F.col("_n") > HOT_ROWS) & (F.col("_n") * HOT_SHARE > rows))


def groups(docs: DataFrame, digest: DataFrame, rows: int) -> DataFrame:
    """One row per distinct text: pointer, largest doc_id and number of rows."""
    hot = checkpoint(_hot(digest.groupBy("_d").agg(F.count("*").alias("_n")), rows).select("_d", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    local = (
        _identified(docs)
        .join(F.broadcast(hot), "_d", "left")
        .withColumn("_salt", salt.cast("int"))
        .groupBy("_d", "_salt", "_t")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    )
    # A cold text is complete here; only the salted winners carry their text on.
    salted = F.col("_salt") > 0
    return (
        local.select(
            "_d",
            F.xxhash64("_t").alias("_x"),
            F.length("_t").alias("_l"),
            F.when(salted, F.col("_t")).alias("_full"),
            F.when(~salted, F.col("_keep")).alias("_cold"),
            "_keep",
            "_n",
        )
        .groupBy("_d", "_x", "_l", "_full", "_cold")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .select("_d", "_x", "_l", "_keep", "_n")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    * the largest doc_id of equal texts stays; a null doc_id is the smallest,
      and a group of null doc_ids has a null keep_id;
    * a repeated row (same doc_id and text) counts in group_size and is
      ``kept`` with its equal; ``keep_one`` then leaves one of them;
    * an empty table gives no rows; other columns are not read.
    """
    digest = digests(docs)
    rows = digest.count()
    found = checkpoint(groups(docs, digest, rows))
    hot = _hot(found, rows).select("_d", "_x", "_l", F.col("_keep").alias("_hk"), F.col("_n").alias("_hn"))
    cold = found.withColumn("_s", F.lit(0).cast("long"))
    spread = F.when(F.col("_hn").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    out = (
        digest.join(F.broadcast(hot), ["_d", "_x", "_l"], "left")
        .withColumn("_s", spread.cast("long"))  # rows of hot groups are answered: spread them
        .join(cold, ["_d", "_x", "_l", "_s"], "left")
    )
    # _hk may be null in a hot group of null ids, so the count decides.
    is_hot = F.col("_hn").isNotNull()
    keep = F.when(is_hot, F.col("_hk")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_hn", "_n").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with one row of every group of equal texts: of the
    rows of the largest doc_id the one whose JSON has the least SHA-256."""
    found = checkpoint(exact_duplicates(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")))
    keys = {"doc_id": docs["doc_id"].cast("long"), "digest": F.unhex(F.sha2(lower_az(text_of()), 256))}
    out = without(docs, found.filter(~F.col("kept")).select("doc_id", "digest"), keys)
    return one_each(out, found.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1"), keys)
