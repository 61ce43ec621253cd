"""Document quality by a conditional random field over lines (see ``crf``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import prepare, text_of

#: Labelled rows that the model is fitted on, the least by hash of doc_id.
TRAIN_ROWS = 8000
#: Longer texts are not learnt from (all are scored), so that the driver holds at
#: most TRAIN_ROWS times as many characters.
TRAIN_CHARS = 50_000
THRESHOLD = 0.3


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves remainder 0; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5) -> crf.Model:
    """Learn from ``labels`` (doc_id, quality) outside the held-out fold.

    Of a document with several labels the larger counts; null labels don't."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
        .filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"), folds))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_t")).filter(F.length("_t") <= TRAIN_CHARS)
    # At most ``rows`` ids are broadcast and as many labelled texts collected.
    got = texts.join(F.broadcast(known), "_id").orderBy(F.xxhash64("_id", "_t")).limit(rows).select("_t", "_y").toPandas()
    return crf.train(got["_t"].tolist(), got["_y"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score reads the text alone. Null, empty and blank texts score the share
    of label 1. Equal texts score alike; an empty table gives no rows; without
    usable labels every score is 0.5 or the only label's share."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, folds=folds)
    df = docs.select(F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
