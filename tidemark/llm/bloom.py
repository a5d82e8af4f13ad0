"""A blocked Bloom filter made and asked with column expressions.

It is a table of 256-bit blocks; a value sets one bit in each of the eight words of one block. Its
size has a fixed bound, so it can always be sent to every executor; beyond that bound only its share
of false hits grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Bits of filter per value, and the most blocks (of 32 bytes) that it may have.
BITS_PER_VALUE, MOST_BLOCKS = 16, 1 << 17


def blocks_for(count: int, most: int = MOST_BLOCKS) -> int:
    return max(1, min(most, -(-count * BITS_PER_VALUE // (32 * WORDS))))


def _bits(value: Column) -> list[Column]:
    spread = F.xxhash64(value, F.lit(1))
    spot = lambda j: F.shiftrightunsigned(spread, 5 * j).bitwiseAND(F.lit(31).cast("bigint")).cast("int")
    return [F.call_function("shiftleft", F.lit(1), spot(j)) for j in range(WORDS)]


def build(values: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter as rows: bloom_block, w0 .. w7."""
    value = F.col(column)
    bits = values.select(F.pmod(F.xxhash64(value), F.lit(blocks)).alias("bloom_block"), *[b.alias(f"w{j}") for j, b in enumerate(_bits(value))])
    return bits.groupBy("bloom_block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def ask(df: DataFrame, column: str, values: DataFrame, value_column: str, most_blocks: int = MOST_BLOCKS, count: int | None = None) -> DataFrame:
    """`df` with a boolean column maybe: false only where `column` is surely not among the values."""
    blocks = blocks_for(values.count() if count is None else count, most_blocks)
    probe = df.withColumn("bloom_block", F.pmod(F.xxhash64(column), F.lit(blocks)))
    hit = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(b) != 0 for j, b in enumerate(_bits(F.col(column)))])
    met = probe.join(F.broadcast(build(values, value_column, blocks)), "bloom_block", "left")
    return met.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))
