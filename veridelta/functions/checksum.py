"""Row hashes and segment checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 48 bits of MD5 around zero.
HEX_DIGITS = 12
OFFSET = (1 << 48) - 1 >> 1
NULL_TEXT = "<null>"


def md5_as_int(text: Column) -> Column:
    tail = F.substring(F.md5(text), 33 - HEX_DIGITS, HEX_DIGITS)
    return F.conv(tail, 16, 10).cast("long") - OFFSET


def md5_as_hex(text: Column) -> Column:
    return F.md5(text)


def joined_text(texts: list[Column], separator: str = "|", hashed: bool = False) -> Column:
    """Texts joined, nulls named; a single text is left bare. ``hashed`` joins their
    MD5 instead, which bounds the length, as sources with short strings need."""
    if hashed:
        texts = [F.md5(F.coalesce(t, F.lit(NULL_TEXT))) for t in texts]
    if len(texts) == 1:
        return texts[0]
    parts: list[Column] = []
    for t in texts:
        parts += [F.lit(separator), F.coalesce(t, F.lit(NULL_TEXT))]
    return F.concat(*parts[1:])


def row_hash(texts: list[Column]) -> Column:
    return md5_as_int(joined_text(texts))


def checksum(texts: list[Column]) -> Column:
    """Sum of row hashes; commutative, so it is combined before the shuffle. Null
    over no rows. A decimal sum can't overflow at any size."""
    return F.sum(row_hash(texts).cast("decimal(38,0)"))


def strong_hash(texts: list[Column]) -> Column:
    """64-bit row hash that tells nulls and field borders apart (for pruning)."""
    flags = F.concat(*(F.when(t.isNull(), F.lit("0")).otherwise(F.lit("1")) for t in texts))
    lengths = F.concat_ws(",", *(F.coalesce(F.length(t), F.lit(-1)).cast("string") for t in texts))
    return F.xxhash64(flags, lengths, *texts)
