"""A filter of 64-bit hashes whose size has a bound: built by grouping, sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.vec import ODD, U64, mixed

#: Bits a hash, bits of all at least and at most (64 MB), and bits that each hash sets. A full filter passes more: that costs time only.
BITS_A_HASH, FILTER_BITS, PROBES = 24, (1 << 18, 1 << 29), 4


def spots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of the bits of each hash among 2 ** bits."""
    return [mixed(hashes + U64((ODD * (k + 1)) & (2**64 - 1))) >> U64(64 - bits) for k in range(PROBES)]


class Filter:
    """Bits that hashes have set."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may have been set; one that was always is."""
        out = np.ones(len(hashes), bool)
        for at in spots(hashes, self.bits):
            out &= (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0
        return out


def filter_of(hashes: DataFrame) -> Broadcast:
    """The filter of a table of one column of hashes (long)."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], BITS_A_HASH * hashes.count())).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in spots(batch.column(0).to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["at", "bit"])

    found = hashes.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()  # as many rows as words of the filter
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(Filter(words, bits))
