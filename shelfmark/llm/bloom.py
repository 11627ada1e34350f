"""Bloom filters of ids, so that a join moves only the rows it may concern.

A filter has BITS bits for each id, up to MOST bits in all (32 MB), which is what is broadcast at
the most. Beyond that it lets more rows through; the exact join behind it decides in any case.

Defined cases: null ids are in no filter; repeated ids count once more for its size; an empty
set of ids gives a filter that nothing passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES, MOST = 12, 4, 1 << 28


def maybe_in(ids: DataFrame, value: Column, most: int = MOST) -> Column:
    """Whether a value may be one of the ids, the only column of ``ids``: never false for one that is.

    The bits are gathered by word, so no executor holds a whole filter while it is made.
    """
    held = ids.select(F.xxhash64(ids.columns[0]).alias("h")).where(F.col(ids.columns[0]).isNotNull())
    bits = min(most, max(1 << 10, 1 << int(np.ceil(np.log2(max(1, held.count()) * BITS)))))
    mask = F.lit(bits - 1).cast("bigint")
    # two halves of the hash give all places: low + k * high
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32)
    spots = F.explode(F.array(*[(low + F.lit(k) * high).bitwiseAND(mask) for k in range(HASHES)]))
    place = held.select(spots.alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shipped = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        bitmap = shipped.value.view(np.uint64)
        x = h.to_numpy(np.int64)
        a, b = x & 0xFFFFFFFF, (x.view(np.uint64) >> np.uint64(32)).astype(np.int64)
        out = np.ones(len(x), bool)
        for k in range(HASHES):
            p = (a + k * b) & (bits - 1)
            out &= (bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(out)

    return value.isNotNull() & test(F.xxhash64(value))
