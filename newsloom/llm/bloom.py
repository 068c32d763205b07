"""A Bloom filter over a column of longs, gathered from all tasks and broadcast; its size follows the number of names, up to a bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
HASHES = 2
#: Bits of the smallest and of the largest filter (32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _places(names: np.ndarray, bits: int) -> list[np.ndarray]:
    x = names.view(np.uint64)
    return [(mix(x + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(bits - 1)).astype(np.int64) for k in range(1, HASHES + 1)]


def bits_for(names: int) -> int:
    """Sixteen bits a name, as a power of two within the bounds. Beyond the upper one more passes; a join behind must drop it."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, names) - 1).bit_length()))


def gather(names: DataFrame, bits: int):
    """A broadcast of the filter over the one long column of ``names``; ``bits`` is a power of two."""

    def run(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = own.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used])], names=["at", "b"])

    rows = names.mapInArrow(run, "at int, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["b"].to_numpy()
    return names.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def may_hold(held: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where a name may be among those gathered; false is sure."""
    keep = np.ones(len(names), bool)
    for at in _places(names, 8 * len(held)):
        keep &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return keep
