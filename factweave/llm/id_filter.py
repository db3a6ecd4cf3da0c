"""A digest of many ids, for tasks to tell which rows can't have one of them.

It is a Bloom filter whose size is bounded, so it may be broadcast whatever the table.
A row that it lets through may still have another id: an exact join has to follow.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each id (at least), bits that an id sets, and the most bits in all (as a power of 2: 8 MB).
BITS_OF_AN_ID, PROBES, MOST = 16, 3, 26


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """The bits of the ids, in words of 64. ``ids`` is read twice; beyond 4 million ids more rows pass than need to."""
    bits = 1 << min(MOST, max(10, (BITS_OF_AN_ID * ids.count()).bit_length()))
    h = F.xxhash64(column)
    low, step = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = F.explode(F.array(*((low + step * i).bitwiseAND(bits - 1) for i in range(PROBES))))
    words = ids.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether ids of these hashes (Spark's xxhash64) may be among those of the filter; all that are give true."""
    bits = len(words) << 6
    low, step = h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF | 1
    out = np.ones(len(h), bool)
    for i in range(PROBES):
        p = (low + step * i) & (bits - 1)
        out &= (words[p >> 6] >> (p & 63)) & 1 > 0
    return out


def may_be_in(column: str, words: Broadcast) -> Column:
    """The same as a column of a frame; only hashes go to Python."""

    @F.pandas_udf("boolean")
    def told(h):
        import pandas as pd

        return pd.Series(may_hold(words.value, h.to_numpy()))

    return told(F.xxhash64(column))
