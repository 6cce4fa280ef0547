"""Sets of keys as bitmaps of fixed width: no false negatives, few false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 15  # a bitmap row covers 2**15 bits, 4 KB


def width_for(keys: int) -> int:
    """Bits, as a power of two, at which ``keys`` keys let one stranger in sixteen or fewer pass."""
    return max(PART, (16 * max(1, keys)).bit_length() - 1)


def _place(key: Column, width: int) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << width) - 1)


def bitmap_of(keys: DataFrame, key: str, width: int) -> DataFrame:
    """``part`` and ``bits``: at most 2**(width - PART) rows, whatever the number of keys."""
    place = _place(F.col(key), width)
    return keys.groupBy(F.shiftright(place, PART).alias("part")).agg(
        F.bitmap_construct_agg(place.bitwiseAND((1 << PART) - 1)).alias("bits")
    )


def union_of(*bitmaps: DataFrame) -> DataFrame:
    every = bitmaps[0]
    for bitmap in bitmaps[1:]:
        every = every.unionByName(bitmap)
    return every.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))


def with_membership(df: DataFrame, key: str, bitmap: DataFrame, width: int, name: str) -> DataFrame:
    """Add ``name``: whether the key may be in the set. The bitmap's size is fixed, so it is broadcast."""
    place = _place(F.col(key), width)
    at = place.bitwiseAND((1 << PART) - 1)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    return (
        df.withColumn("part", F.shiftright(place, PART))
        .join(F.broadcast(bitmap), "part", "left")
        .withColumn(name, F.coalesce(found, F.lit(False)))
        .drop("part", "bits")
    )
