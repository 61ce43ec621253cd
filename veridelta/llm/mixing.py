"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: target weight x all text / its text.
A document's copies are the inverse Poisson distribution with that mean at a
uniform number seeded by the document's hash, so the draw is repeatable and
needs no state. A rate over MOST is the sum of equal draws of at most MOST, each
at a uniform number of its own. Copies are exploded and shuffled globally by a
hash key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, text_of

SEED = "mix-1"
#: Copies of one document that one step makes: a row never holds a longer list.
STEP = 4096
#: exp(-rate) must not underflow; larger rates are drawn in parts.
MOST = 700.0


def _digest(seed: str) -> Column:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}|"), ident, F.lit("|"), text_of()))


def _unit(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def uniform(seed: str = SEED) -> Column:
    """48 bits of MD5 over seed, doc_id and text, in [0, 1)."""
    return _unit(_digest(seed))


def _further(cdf: Column, parts: Column, seed: str) -> Column:
    """Sum of the draws 1.. of ``parts``; the MD5 of a draw's number and of the
    document's first digest gives its uniform number."""

    def draw(digest: Column, k: Column) -> Column:
        at = F.array(_unit(F.md5(F.concat(k.cast("string"), F.lit("|"), digest))))
        return F.element_at(F.transform(at, lambda u: F.size(F.filter(cdf, lambda c: c <= u))), 1)

    def total(digest: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), parts - 1), F.lit(0), lambda n, k: n + draw(digest, k))

    return F.element_at(F.transform(F.array(_digest(seed)), total), 1)


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0.. until what is left is under 2^-48."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    p0 = F.exp(-rate)
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.array(p0).alias("cdf"), p0.alias("p")),
        lambda a, k: F.struct(
            F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * rate / k).alias("cdf"), (a["p"] * rate / k).alias("p")
        ),
        lambda a: a["cdf"],
    )


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """source, rate: mean repetitions that reach the target weights.

    ``weights`` gives each source's share (normalised; an unnamed source has
    weight 0). By default the share is the source's characters to the power
    ``alpha``: large sources are damped, small ones repeated."""
    mass = checkpoint(docs.groupBy("source").agg(F.sum(F.length(text_of())).alias("mass")))
    if weights is None:
        weighed = mass.withColumn("w", F.sqrt("mass") if alpha == 0.5 else F.pow("mass", F.lit(alpha)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        weighed = mass.join(named, F.col("source").eqNullSafe(F.col("k")), "left").fillna(0.0, ["w"]).drop("k")
        weighed = weighed.withColumn("w", F.when(F.col("mass") > 0, F.col("w")).otherwise(0.0))
    total = weighed.agg(F.sum("mass").alias("m"), F.sum("w").alias("w")).first()
    all_mass, all_w = float(total["m"] or 0), float(total["w"] or 0)
    if all_mass == 0 or all_w == 0:
        return weighed.select("source", F.lit(1.0 if weights is None else 0.0).alias("rate"))
    rate = F.when(F.col("mass") > 0, F.col("w") / F.lit(all_w) * F.lit(all_mass) / F.col("mass")).otherwise(1.0)
    return weighed.select("source", rate.cast("double").alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, alpha: float = 0.5) -> DataFrame:
    """``docs`` (all its columns) with ``mix_copy`` (1..n) and ``mix_key``: each
    document as often as drawn, in a global random order.

    A null source is a source of its own; null text is empty and weighs
    nothing (rate 1 where a source has no text at all). Equal rows draw the
    same number. A column of docs with one of these two names is replaced; columns
    doc_id, text and source are needed (ValueError)."""
    if lacking := {"doc_id", "text", "source"} - set(docs.columns):
        raise ValueError(f"documents lack {', '.join(sorted(lacking))}")
    rate = rates(docs, weights, alpha).withColumn("_vd_parts", F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1)).cast("long"))
    rate = checkpoint(rate.select(F.col("source").alias("_vd_source"), "_vd_parts", _cdf(F.col("rate") / F.col("_vd_parts")).alias("_vd_cdf")))
    if rate.count() <= BROADCAST_ROWS // 100:  # a CDF has some 40 numbers
        rate = F.broadcast(rate)
    columns = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    df = docs.select(*(F.col(f"`{c}`") for c in columns))
    first = F.size(F.filter("_vd_cdf", lambda c: c <= F.col("_vd_u")))
    more = F.when(F.col("_vd_parts") > 1, _further(F.col("_vd_cdf"), F.col("_vd_parts"), seed)).otherwise(0)
    drawn = (
        df.withColumn("_vd_u", uniform(seed))
        .join(rate, F.col("source").eqNullSafe(F.col("_vd_source")), "left")
        .withColumn("_vd_n", first + more)
        .filter("_vd_n > 0")
    )
    steps = F.sequence(F.lit(0), F.floor((F.col("_vd_n") - 1) / STEP).cast("int"))
    drawn = drawn.select("*", F.explode(steps).alias("_vd_step")).withColumn("_vd_low", F.col("_vd_step") * STEP + 1)
    range_ = F.sequence(F.col("_vd_low"), F.least(F.col("_vd_low") + STEP - 1, F.col("_vd_n")))
    copies = drawn.select(*(F.col(f"`{c}`") for c in columns), F.explode(range_).alias("mix_copy"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text_of()), F.col("mix_copy"))
    copies = copies.withColumn("mix_key", key)
    # The map partition in the shuffle key parts equal rows; the order is the key's.
    return copies.repartition(F.col("mix_key"), F.spark_partition_id()).sortWithinPartitions("mix_key")
