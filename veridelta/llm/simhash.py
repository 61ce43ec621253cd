"""SimHash near-dedup with a covering family of bit masks.

Fingerprints are 64 bits. For radius r every bit gets a vector of r+1 bits; mask
v (of 2^(r+1)-1) holds the bits whose vector has an odd product with v. The
vectors of any r bits leave some v orthogonal to all of them, so two
fingerprints that differ in at most r bits are equal under that mask: no pair
within the radius is missed, and candidates are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, one_each, prepare, spread_join, text_of, without
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints of one bucket that a task compares directly; larger
#: buckets take ``_stars``, which is exact too and linear in the bucket.
DIRECT = 8192

#: Mixing of a hash into the words of a long fingerprint.
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 64, 64, np.uint64)
_MUL = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """2^(radius+1)-1 masks over 64 bits that cover every pair within ``radius``."""
    vectors = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        bits = [i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2]
        masks.append(sum(1 << i for i in bits))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned SimHash of all ``words``-word shingles, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    line = memoryview(b" ".join(parts))
    k = min(words, len(parts))
    first, last = starts[: len(parts) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    ones, total, digest = np.zeros(64, np.int64), len(first), xxhash.xxh64_intdigest
    for i in range(0, total, 1 << 16):
        block = np.array([digest(line[a:b], SEED) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)])], ">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def long_fingerprint(hashes: np.ndarray, words64: int) -> np.ndarray:
    """SimHash of ``words64`` words of 64 bits over the given 64-bit hashes; each word
    takes the bits of another mixing of them."""
    ones = np.zeros(64 * words64, np.int64)
    for i in range(0, len(hashes), 255):  # counts of 255 fit a byte
        mixed = (hashes[i : i + 255, None] ^ _XOR[:words64]) * _MUL[:words64]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _MUL[:words64]
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view("<u8")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp (long) for every row; null text is empty."""
    prepare(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t.as_py(), words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return df.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _bucket_links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one bucket as all pairs within the radius
    would: one for each member but the first of its cluster."""
    rest, a, b = np.unique(members.astype(np.int64)).view(np.uint64), [], []
    while len(rest):
        front, root, rest = [rest[0]], rest[0], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = rest[near]
                front.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
                rest = rest[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _stars(large: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of buckets too large to compare: every member is dealt to all points
    within radius/2 of it on the bits outside the mask. Two members share a point
    exactly when they are within the radius, and each point links its members to
    its least one, so no pair is made and none is lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        balls: dict[int, np.ndarray] = {}

        def ball(v: int) -> np.ndarray:
            if v not in balls:
                free = [1 << i for i in range(64) if not masks[v] >> i & 1]
                balls[v] = np.array([sum(c) for k in range(radius // 2 + 1) for c in combinations(free, k)], np.uint64)
            return balls[v]

        for batch in batches:
            for v, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)):
                points = fp ^ ball(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), v)), pa.array(points.view(np.int64)), pa.array(np.full(len(points), np.uint64(fp).view(np.int64)))],
                    ["v", "point", "fp"],
                )

    dealt = checkpoint(large.mapInArrow(run, "v long, point long, fp long"))
    least = dealt.groupBy("v", "point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    links = dealt.join(least, ["v", "point"]).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return links.filter("a <> b").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """a, b: links between distinct fingerprints (``fp``) whose components are
    those of all pairs within ``radius``."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    keys = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)))
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("k.v", "k.key", "fp")
    bucket = checkpoint(
        keyed.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    out = bucket.filter("n = 2").filter(close).select("a", "b")
    more = bucket.filter("n > 2").select("v", "key", "n")
    if more.isEmpty():
        return out
    members = checkpoint(keyed.join(more, ["v", "key"]))
    grouped = members.filter(F.col("n") <= direct).groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in batch.column(0):
                a, b = _bucket_links(fps.values.to_numpy(zero_copy_only=False), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    out = out.union(grouped.mapInArrow(run, "a long, b long"))
    large = members.filter(F.col("n") > direct).select("v", "fp")
    return out if large.isEmpty() else out.union(_stars(large, masks, radius))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable over fingerprints within
    ``radius`` bits (null only where the component has no doc_id at all). Null,
    empty and blank texts have fingerprint zero and link like any other.
    Repeated rows come back repeated. An empty table gives no rows."""
    fps = checkpoint(fingerprints(docs, words))
    least = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    root = components(links(least.select("fp"), radius, direct)).withColumnRenamed("node", "fp")
    rooted = least.join(root, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = checkpoint(rooted.join(lowest, "root").select("fp", "n", "component_id"))
    out = spread_join(fps, found, "fp", "n", fps.count(), "doc_id")
    return out.select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, group: Column) -> DataFrame:
    """``docs`` with one document of every component of ``found``; ``group`` tells
    components without an id apart. Of rows that repeat id and text one stays."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("text_hash"))
    key = F.coalesce(F.col("component_id").cast("string"), group.cast("string"))
    found = checkpoint(found.select("doc_id", "text_hash", key.alias("c")))
    first = found.groupBy("c").agg(F.min(rank).alias("r"), F.count("*").alias("n"))
    stays = checkpoint(first.select("c", "n", F.col("r.doc_id").alias("kd"), F.col("r.text_hash").alias("kt")))
    with_first = spread_join(found, stays, "c", "n", found.count(), "doc_id")
    stay = F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("text_hash") == F.col("kt"))
    keys = {"doc_id": docs["doc_id"].cast("long"), "text_hash": F.xxhash64(text_of())}
    out = without(docs, with_first.filter(~stay).select("doc_id", "text_hash"), keys)
    return one_each(out, found.groupBy("doc_id", "text_hash").count().filter("count > 1"), keys)


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` (all its columns) with one document of every component, the one of
    the least doc_id (of several texts with that id, the least text hash; of rows
    with that id and text, the least SHA-256 of the row's JSON)."""
    return keep_first(docs, near_duplicates(docs, words, radius), F.col("fingerprint"))
