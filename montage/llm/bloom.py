"""A blocked Bloom filter as a table of packed rows.

A block has 256 bits, four long words; a key picks a block by one hash and sets eight of its bits, one in each half word,
by another. Build is a map-side combined aggregate whose blocks are then packed, CHUNK of them in order to an array, so
that a row's overhead does not count; probing joins on the chunk's number and looks the words up by place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 256
#: Blocks of a packed row.
CHUNK = 256


@dataclass(frozen=True)
class BlockedBloom:
    """`table` has columns chunk and words; None where its size would be over the bound, so that it decides nothing."""

    table: DataFrame | None
    blocks: int

    def maybe(self, df: DataFrame, key: Column, flag: str) -> DataFrame:
        """`df` with a boolean column `flag`: false only where `key` is surely not in the set; null keys are not."""
        if self.table is None:
            return df.withColumn(flag, key.isNotNull())
        chunk, words = f"{flag}_c", f"{flag}_w"
        side = F.broadcast(self.table.select(F.col("chunk").alias(chunk), F.col("words").alias(words)))
        block, h = _block(key, self.blocks), F.xxhash64(key, F.lit(1))
        place = (block % CHUNK * 4).cast("int")
        hit = F.lit(True)
        for i in range(4):
            mask = _word(h, i)
            hit = hit & (F.get(F.col(words), place + i).bitwiseAND(mask) == mask)
        joined = df.join(side, F.when(key.isNotNull(), F.floor(block / CHUNK)) == F.col(chunk), "left")
        return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(chunk, words)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _word(h: Column, i: int) -> Column:
    """Bits that a key of hash h sets in word i of its block: one in each half."""
    low, high = (F.shiftrightunsigned(h, 10 * i + 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int") for k in range(2))
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high + 32))


def build(keys: DataFrame, key: str, most: int | None = None, most_bytes: int = 64 << 20) -> BlockedBloom:
    """The filter of the distinct non-null values of `keys[key]`, for `most` of them (counted where that is None).

    It is broadcast when probed, so it has a table only if its bits fit in `most_bytes` (32 million keys).
    """
    some = keys.select(F.col(key).alias("k")).filter(F.col("k").isNotNull())
    n = some.agg(F.count_distinct("k").alias("n")).first()["n"] if most is None else most
    blocks = CHUNK
    while blocks * BLOCK_BITS < n * BITS_PER_KEY:
        blocks *= 2
    if blocks * BLOCK_BITS > 8 * most_bytes:
        return BlockedBloom(None, blocks)
    h = F.xxhash64("k", F.lit(1))
    set_bits = some.select(_block(F.col("k"), blocks).alias("block"), *(_word(h, i).alias(f"w{i}") for i in range(4)))
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block"), *(F.lit(0).cast("long").alias(f"w{i}") for i in range(4)))
    filled = set_bits.union(every).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))
    packed = filled.groupBy(F.floor(F.col("block") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("block", F.array("w0", "w1", "w2", "w3").alias("w")))).alias("rows"))
    return BlockedBloom(packed.select("chunk", F.flatten(F.transform("rows", lambda r: r["w"])).alias("words")), blocks)
