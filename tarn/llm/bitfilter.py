"""A bit filter of fixed size over 64-bit hashes.

It spares a shuffle of all texts where only the rows of a (possibly small) key set are needed. It
may let other rows pass, never the reverse, so results do not depend on it. Its size is fixed at
``BITS`` whatever the input, which bounds what is brought to the driver and broadcast; on inputs
that fill it, every row passes and the join behind it does the work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^23 bits: 1 MB.
BITS = 1 << 23


def build(keys: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of arrays of 64-bit hashes against the long column; picklable, for use in workers."""
    spark = keys.sparkSession
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.expr(f"pmod(`{column}`, {BITS}L)").alias("b"))
        .select(F.expr("int(b div 64)").alias("w"), F.expr("shiftleft(1L, int(b % 64))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
    )
    table = np.zeros(BITS // 64, np.int64)
    found = words.toArrow()  # at most BITS / 64 rows
    table[found.column("w").to_numpy()] = found.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def test(hashes: np.ndarray) -> np.ndarray:
        at = np.mod(hashes.astype(np.int64), BITS).astype(np.uint64)
        return (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    return test
