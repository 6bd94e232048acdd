"""Bitmaps of ids: a bounded filter that tells tasks which rows cannot meet a join partner."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(positions: DataFrame, bits: int) -> bytes:
    """Bits at the positions (a long column ``p``, 0 to bits - 1), built by aggregation: ``bits / 8`` bytes in all.

    The bit of position p is ``out[p >> 3] >> (p & 7) & 1``.
    """
    place = F.col("p") + 1  # Spark's bitmap functions count from 1
    out = bytearray(bits // 8)
    for bucket, part in (positions.groupBy(F.bitmap_bucket_number(place).alias("b"))
                         .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()):
        at = (bucket - 1) * len(part)
        out[at:at + len(part)] = part[:len(out) - at]
    return bytes(out)


class KeyFilter:
    """Of any value, whether it is surely not in a column; a few other values pass too, so an exact join follows.

    Some 16 bits for each row of the column, 16 MB at most; beyond that more values pass.
    """

    def __init__(self, keys: DataFrame):
        key = F.col(keys.columns[0])
        bits = 1 << min(27, max(16, int(16 * keys.count()).bit_length()))
        self.bits = bits
        self.flags = bitmap(keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("p")), bits)

    def may_hold(self, key: str) -> Column:
        flags = self.flags

        @F.pandas_udf("boolean")
        def held(place: pd.Series) -> pd.Series:
            p = place.to_numpy()
            return pd.Series((np.frombuffer(flags, dtype=np.uint8)[p >> 3] >> (p & 7).astype(np.uint8) & 1) > 0)

        return held(F.pmod(F.xxhash64(F.col(key)), F.lit(self.bits)))
