"""A bitmap of fixed size over keys, tested where the rows are read.

It thins out a large table before it is shuffled to a join: keys that the other side does not have mostly go,
none that it has are lost, and the join itself stays exact. The bitmap does not grow with the data (one
megabyte, or as many 64-bit words as both functions are told); once more keys than it can tell apart are set, it lets all rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 17  # of 64 bits


def _place(words: int, *keys: Column) -> Column:
    return F.xxhash64(*keys).bitwiseAND(words * 64 - 1)


def bitmap(spark: SparkSession, rows: DataFrame, *keys: str, words: int = WORDS) -> Column:
    """The bitmap of the keys as a scalar subquery."""
    place = rows.select(_place(words, *(F.col(k) for k in keys)).alias("place"))
    set_bits = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))).alias("bits"))
    every = spark.range(words).select(F.col("id").alias("word")).join(set_bits, "word", "left").select(
        "word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()


def may_hold(bits: Column, *keys: Column, words: int = WORDS) -> Column:
    place = _place(words, *keys)
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
