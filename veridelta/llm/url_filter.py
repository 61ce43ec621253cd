"""URL rules answered by Bloom filter cascades (built-in functions only).

The key universe is every key that some url of the corpus could match: a host
suffix with a path prefix of a length that some rule has. Level 0 of a cascade
is a Bloom filter of the listed keys; level 1 of the universe's keys that pass
level 0 unlisted; level 2 of the listed keys that pass level 1; and so on until
nothing passes. Walking the levels is exact on the whole universe, and a url is
judged without any join. A cascade's size follows the listed keys: its size is
checked against ``MAX_BYTES``, and larger lists are joined by key instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

#: Bits and hashes for each key: of level 0 and of the deeper levels.
FIRST, DEEPER = (16, 8), (8, 4)
#: Bytes of all levels of one cascade that may go into the plan.
MAX_BYTES = 32_000_000

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(df: DataFrame, lengths: list[int], labels: list[int]) -> DataFrame:
    """Add ``_vd_keys``: structs (n, h, key) of all that a rule could match: suffixes of
    the host of as many labels as some rule's host, with path prefixes of the lengths
    of the rules' paths."""
    had = F.length("_vd_host") - F.length(F.replace("_vd_host", F.lit("."), F.lit(""))) + 1
    none = F.expr("cast(array() as array<string>)")
    suffixes = F.array_compact(F.array(*(F.when(had >= k, F.substring_index("_vd_host", ".", -k)) for k in labels))) if labels else none
    df = df.withColumn("_vd_suffixes", F.filter(suffixes, lambda s: s != ""))
    paths = F.array_compact(
        F.array(*(F.when(F.length("_vd_path") >= n, F.substring("_vd_path", 1, n)) for n in lengths))
    ) if lengths else none
    df = df.withColumn("_vd_paths", paths)
    keys = F.flatten(
        F.transform(
            "_vd_suffixes",
            lambda s: F.transform(
                F.col("_vd_paths"),
                lambda p: F.struct((F.length(s) + F.length(p)).alias("n"), F.length(s).alias("h"), F.concat(s, p).alias("key")),
            ),
        )
    )
    return df.withColumn("_vd_keys", keys).drop("_vd_suffixes", "_vd_paths")


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


class Level:
    """One Bloom filter as a binary constant."""

    def __init__(self, keys: DataFrame, count: int, level: int):
        per_key, self.hashes = FIRST if level == 0 else DEEPER
        self.level, self.bits = level, max(64, count * per_key)
        places = F.explode(F.array(*_positions(F.col("key"), level, self.bits, self.hashes)))
        rows = (
            keys.select(places.alias("p"))
            .groupBy(F.floor(F.col("p") / 8).alias("byte"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("b"))
        )
        data = bytearray((self.bits + 7) // 8)
        for r in rows.toLocalIterator():  # at most as many rows as the filter has bytes
            data[r["byte"]] = r["b"]
        self.data = bytes(data)

    def contains(self, key: Column) -> Column:
        """A byte is read by position; its bit is tested."""

        def bit(data: Column, p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (p % 8).cast("int")) == 1

        places = _positions(key, self.level, self.bits, self.hashes)
        # The bytes stand in the plan once, however many places are read.
        return let(F.lit(self.data), lambda data: reduce(lambda a, b: a & b, (bit(data, p) for p in places)))


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = checkpoint(listed.select("key").filter("key is not null").distinct())
        self.levels: list[Level] = []
        count, outside, members = inside.count(), None, inside
        while count:
            if sum(len(x.data) for x in self.levels) + count * 2 > MAX_BYTES:
                raise OverflowError("the cascade exceeds MAX_BYTES")
            level = Level(inside, count, len(self.levels))
            self.levels.append(level)
            if outside is None:
                passed = universe.select("key").filter(level.contains(F.col("key"))).withColumn("l", F.lit(0))
                both = passed.union(members.withColumn("l", F.lit(1))).groupBy("key").agg(F.max("l").alias("l"))
                outside = both.filter("l = 0").select("key")
            else:
                outside = outside.filter(level.contains(F.col("key")))
            outside = checkpoint(outside)
            inside, outside, count = outside, inside, outside.count()

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.contains(key) & ~out
        return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_column: str = "page_id", default: str = ALLOW) -> DataFrame:
    """``id_column``, host, path, rule, verdict for every row of ``pages``.

    ``rules`` are (verdict, host, path). A rule fits its host and the host's
    subdomains where the url's path starts with the rule's; the longest host +
    path wins, of equal lengths the longer host. A url that no rule fits has a
    null rule and the ``default`` verdict. A null url or one without ``://`` has
    an empty host and path, which no rule fits. Repeated rows are judged alike;
    an empty table gives no rows. Only the id and url are read."""
    rules = list(rules)
    listed = {v: sorted({h + p for verdict, h, p in rules if verdict == v}) for v in (ALLOW, BLOCK)}
    if any(v not in listed or not h for v, h, _ in rules) or set(listed[ALLOW]) & set(listed[BLOCK]):
        raise ValueError("rules need a host and one verdict: allow or block")
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col(id_column).alias("_vd_id"), host.alias("_vd_host"), path.alias("_vd_path"))
    df = candidates(df, lengths, sorted({h.count(".") + 1 for _, h, _ in rules}))
    frames = {v: spark.createDataFrame([(k,) for k in keys], "key string") for v, keys in listed.items()}
    universe = df.select(F.explode("_vd_keys").alias("k")).select("k.key")
    try:
        cascades = {v: Cascade(frames[v], universe) for v in (ALLOW, BLOCK)}
    except OverflowError:
        return _joined(df, frames, id_column, default)
    df = df.withColumn("_vd_fit", F.filter("_vd_keys", lambda k: cascades[ALLOW].contains(k["key"]) | cascades[BLOCK].contains(k["key"])))
    df = df.withColumn("_vd_rule", F.array_max("_vd_fit")["key"])
    verdict = F.when(F.col("_vd_rule").isNull(), F.lit(default)).when(cascades[BLOCK].contains(F.col("_vd_rule")), BLOCK).otherwise(ALLOW)
    return df.select(
        F.col("_vd_id").alias(id_column),
        F.col("_vd_host").alias("host"),
        F.col("_vd_path").alias("path"),
        F.col("_vd_rule").alias("rule"),
        verdict.alias("verdict"),
    )


def _joined(df: DataFrame, frames: dict[str, DataFrame], id_column: str, default: str) -> DataFrame:
    """The same for lists beyond MAX_BYTES: distinct keys meet the list in a join,
    and each url gathers its few keys again."""
    rules = frames[ALLOW].withColumn("v", F.lit(ALLOW)).union(frames[BLOCK].withColumn("v", F.lit(BLOCK)))
    df = checkpoint(df)
    wide = df.select("_vd_host", "_vd_path", F.explode("_vd_keys").alias("k")).distinct()
    best = (
        wide.join(rules, F.col("k.key") == F.col("key"))
        .groupBy("_vd_host", "_vd_path")
        .agg(F.max(F.struct("k.n", "k.h", "key", "v")).alias("m"))
        .withColumnsRenamed({"_vd_host": "_h", "_vd_path": "_p"})
    )
    out = df.join(best, (F.col("_vd_host") == F.col("_h")) & (F.col("_vd_path") == F.col("_p")), "left")
    return out.select(
        F.col("_vd_id").alias(id_column),
        F.col("_vd_host").alias("host"),
        F.col("_vd_path").alias("path"),
        F.col("m.key").alias("rule"),
        F.coalesce("m.v", F.lit(default)).alias("verdict"),
    )
