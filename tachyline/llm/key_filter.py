"""A filter of fixed size that lets all wanted keys through and few others.

It stands before a shuffle: rows whose key can't be wanted needn't travel. The filter holds
one bit per hashed key in BITS bits, 8 MB whatever the number of keys; with many keys more rows
pass, and the join behind it drops them. It never drops a wanted row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_BUCKET = 1 << 15


class KeyFilter:
    def __init__(self, keys: DataFrame, column: str):
        """Collects at most BITS / 32768 bitmaps of 4 kB."""
        place = F.pmod(F.col(column), F.lit(BITS))
        rows = (
            keys.filter(F.col(column).isNotNull())
            .select((place / _BUCKET).cast("int").alias("bucket"), (place % _BUCKET).alias("bit"))
            .groupBy("bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bits"))
            .collect()
        )
        self.buckets = {row["bucket"]: bytes(row["bits"]) for row in rows}

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the signed 64-bit keys may be wanted."""
        if not hasattr(self, "_bytes"):
            held = np.zeros(BITS // 8, np.uint8)
            for bucket, bits in self.buckets.items():
                held[bucket * _BUCKET // 8 : (bucket + 1) * _BUCKET // 8] = np.frombuffer(bits, np.uint8)
            self._bytes = held
        place = keys & (BITS - 1)
        return (self._bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
