"""A bounded filter in front of an exact join: it says which rows cannot find a partner."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at least and at most; the largest is sent around as 32 MB.
LEAST, MOST = 1 << 16, 1 << 28
#: What one row of the built-in bitmap functions holds.
_CHUNK = 1 << 15


def bits_for(n: int) -> int:
    """Some 16 bits a value, between LEAST and MOST."""
    return min(MOST, max(LEAST, 1 << int(16 * max(1, n) - 1).bit_length()))


def bit_table(places: DataFrame, bits: int) -> np.ndarray:
    """Bytes in which the bits of ``places`` (p: long, below ``bits``) are set."""
    at = F.col("p") + 1
    chunks = places.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = np.zeros((bits // _CHUNK, _CHUNK // 8), np.uint8)
    for r in chunks.collect():  # MOST bits at most
        table[r["chunk"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def has_bit(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (table[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def may_be_among(value: Column, values: DataFrame) -> Column:
    """False only where the long ``value`` is none of ``values`` (one long column; nulls are none).

    One bit a hash, some 16 bits a value up to MOST bits in all. Beyond that more rows pass, so that
    whoever filters by it must still join; what is sent around stays bounded.
    """
    spark = values.sparkSession
    (name,) = values.columns
    known = values.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("v"))
    bits = bits_for(known.count())
    table = bit_table(known.select(F.pmod(F.xxhash64(F.lit("bits"), "v"), F.lit(bits)).alias("p")), bits)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        return pd.Series(has_bit(sent.value, at.to_numpy(np.int64)))

    return hit(F.pmod(F.xxhash64(F.lit("bits"), value), F.lit(bits)))
