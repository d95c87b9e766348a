"""A bitmap of fixed size that says which 64-bit keys cannot be in a set.

It is built with a bitwise aggregate and is the only thing broadcast, so what
is broadcast never grows with the data.  With more keys it lets more rows pass;
a join always follows, so results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map (2 MB).
BITS = 24
_MULT = 0x9E3779B97F4A7C15


def places(keys: np.ndarray) -> np.ndarray:
    """Each key's bit."""
    return (keys.view(np.uint64) * np.uint64(_MULT)) >> np.uint64(64 - BITS)


class _Bits:
    """Keys to (word, bits), one row per word and batch."""

    def __call__(self, batches):
        for batch in batches:
            place = np.unique(places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            bit = np.uint64(1) << (place & np.uint64(63))
            bits = np.bitwise_or.reduceat(bit, first) if len(place) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The map as 64-bit words, from at most 2 ** (BITS - 6) rows of the aggregate."""
    rows = (keys.select(key).where(F.col(key).isNotNull()).mapInArrow(_Bits(), "word long, bits long")
                .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are certainly not in the set."""
    place = places(keys)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
