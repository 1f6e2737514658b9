"""A filter of stated size that tells which rows may be in a table, for scans that should not shuffle the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import mix

#: Bits for each row, and the most bits of a filter (16 MiB). A fuller filter passes more rows, and drops none.
BITS, MOST = 16, 1 << 27


def numbers(*columns: pa.Array) -> np.ndarray:
    """64 bits of each row of these columns of whole numbers or nulls."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        empty = column.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
        total = mix(total + mix(values + np.uint64(0x9E3779B97F4A7C15)) + empty)
    return total


class Membership:
    def __init__(self, bits: int, words: Broadcast):
        self.bits, self._words = bits, words

    def passes(self, rows: np.ndarray) -> np.ndarray:
        words = self._words.value
        found = np.ones(len(rows), bool)
        for place in places(rows, self.bits):
            found &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def places(rows: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (rows, rows >> np.uint64(32))]


def membership(table: DataFrame, most: int = MOST) -> Membership:
    """The filter of a written table's rows; its columns are whole numbers."""
    count = table.count()
    bits = 1 << min(max(BITS * count, 1 << 10).bit_length(), most.bit_length() - 1)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in places(numbers(*batch.columns), bits):
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    rows = table.mapInArrow(locate, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = materialize(rows, "filter").toArrow()  # most / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Membership(bits, table.sparkSession.sparkContext.broadcast(words))
