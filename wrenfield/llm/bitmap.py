"""Rows kept back before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_by_bitmap(rows: DataFrame, column: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` of which ``column`` may be in that of ``wanted``: a bitmap of 2^bits places, so at most 2^(bits - 6) rows of 16
    bytes (4 MB), is broadcast whatever the data; false ones stay and are left to the joins that follow."""
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(bitmap), word == F.col("_word")).where(bit.bitwiseAND(F.col("_bits")) != 0).drop("_word", "_bits")
