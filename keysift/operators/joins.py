"""Row filters by a set of keys of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the key set, in bitmaps of 2^15: at most 2^25 bits, 4 MB, whatever the number of keys.
BITS = 1 << 25


def _place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def may_match(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``big`` whose key may be in ``keys``: all that are, and of the others one in
    BITS for each key there.

    The keys' hashes are set in bitmaps, which are broadcast (their size is bounded by BITS), so rows
    that a later join would drop are dropped where they are read, and not shuffled.
    """
    bitmaps = keys.select(_place(*on).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position(_place(*on))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (big.withColumn("_bucket", F.bitmap_bucket_number(_place(*on)))
            .join(F.broadcast(bitmaps), "_bucket")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*big.columns))
