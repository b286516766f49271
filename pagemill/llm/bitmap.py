"""A bitmap of 64-bit keys: of fixed size whatever the number of keys, so always broadcastable.

It only ever lets too much through; what passes is joined with the keys themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
"""2 to this many bits: 8 MB on the driver and in each task."""


def build(keys: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of well-mixed longs; the driver gets at most 2**bits / 64 words."""
    word = F.shiftrightunsigned(F.col(key), 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{key}`, {64 - bits}) & 63 as int))")
    return collect(keys.select(word.alias("w"), bit.alias("b")), bits)


def collect(words: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of words ``w`` and the bits ``b`` to be set in them."""
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint64)


def test(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() - 1 + 6
    at = keys >> np.uint64(64 - bits)
    return ((bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


