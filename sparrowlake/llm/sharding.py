"""Sharding by a Feistel permutation of the global row numbers.

Rows get their number in a total order, gapless from 0: they are range partitioned and
sorted, and a partition's first number is the count of the rows before it (one row a
partition). The number then goes through a keyed Feistel network over the smallest
even number of bits that holds all rows; a result outside the table is put through
again until it falls inside (cycle walking), so the map is a permutation of 0..N-1.
Position p lies in shard p mod S at slot p div S: counts differ by one at most, slots
have no gaps, and both are computed from the row number, N, S and the key alone.

Nulls sort first; rows that are equal in all ordering columns are interchangeable, so
any order of them gives the same table. An empty table gives no rows. Other columns
are carried along; those named row_number, shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.llm.common import U64, add_columns, mix64, stage, without

ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 and its inverse."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = U64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (U64(1) << self.half) - U64(1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key % (1 << 64)))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (left << self.half) | right

    def _swap(self, x: np.ndarray) -> np.ndarray:
        return ((x & self.mask) << self.half) | (x >> self.half)

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = x.astype(U64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = step(out[todo])
            todo = todo[out[todo] >= U64(self.n)]
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, lambda x: self._once(x, self.keys))

    def back(self, positions: np.ndarray) -> np.ndarray:
        return self._walk(positions, lambda x: self._swap(self._once(self._swap(x), self.keys[::-1])))


def locate(row: int, n: int, shards: int, key: int) -> tuple[int, int]:
    """Shard and slot of one row number, without the table."""
    p = int(Feistel(n, key).forward(np.array([row], U64))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The row number that lies in this slot."""
    return int(Feistel(n, key).back(np.array([slot * shards + shard], U64))[0])


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` from 0 in the order of the columns, and the number of rows."""
    at = F.monotonically_increasing_id()
    marked = without(df, ["row_number", "_at"]).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    held, _ = stage(marked, "numbered")
    part = F.shiftright("_at", 33)
    # one row a partition of the sort: the bound of this broadcast is the number of its tasks
    parts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).selectExpr("_part", "sum(_n) OVER (ORDER BY _part) - _n AS _first")
    numbered = held.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return numbered.withColumn("row_number", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_first"), held.count()


def shard(df: DataFrame, order: list[str], shards: int, key: int = 42) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` and ``slot``."""
    numbered, n = number_rows(df, order)

    def make():
        f = Feistel(n, key)

        def of(rows: pa.Array) -> list[pa.Array]:
            p = f.forward(rows.to_numpy(zero_copy_only=False))
            return [pa.array((p % U64(shards)).astype(np.int32)), pa.array((p // U64(shards)).astype(np.int64))]

        return of

    return add_columns(numbered, "row_number", [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())], make)
