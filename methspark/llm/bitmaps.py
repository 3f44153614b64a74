"""Bitmaps of bounded size over 64-bit hashes, built in Spark and broadcast to Arrow functions.

A bitmap lets an Arrow pass skip rows that can't matter. It may let others through, never the reverse, so results don't
depend on it. Its size follows the number of keys up to ``MOST_BITS`` (128 MB); beyond that more rows pass, and the exact join behind
it has more to do.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 30


class Bitmap:
    """A few bits a key, at different slices of its hash."""

    def __init__(self, bits: int, words: np.ndarray, probes: int):
        self.bits, self.words, self.probes = bits, words, probes

    def test(self, h: np.ndarray) -> np.ndarray:
        """Which of the uint64 hashes may be in."""
        mask, found = np.uint64((1 << self.bits) - 1), np.arange(len(h))
        for turn, shift in _slices(self.bits, self.probes):
            own = h[found]
            at = ((own ^ (own >> np.uint64(31)) if turn else own) >> np.uint64(shift)) & mask
            found = found[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(h), dtype=bool)
        out[found] = True
        return out


def _slices(bits: int, probes: int) -> list[tuple[bool, int]]:
    """Whether the hash is folded first, and how far it is shifted, for each probe."""
    return [(False, 0), (False, 64 - bits), (True, (64 - bits) // 2), (True, 0)][:probes]


def bitmap(hashes: DataFrame, count: int, bits_per_key: int = 24, probes: int = 2) -> Broadcast:
    """Of the column ``h`` (well-mixed 64-bit hashes), about ``count`` of them; at most 2^MOST_BITS bits reach the driver."""
    spark = hashes.sparkSession
    bits = min(MOST_BITS, max(16, (bits_per_key * max(1, count) - 1).bit_length()))
    mask = (1 << bits) - 1
    folded = "(h ^ shiftrightunsigned(h, 31))"
    places = [F.expr(f"shiftrightunsigned({folded if turn else 'h'}, {shift}) & {mask}L") for turn, shift in _slices(bits, probes)]
    rows = hashes.select(F.explode(F.array(*places)).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words[found["word"].to_numpy()] = found["bit"].to_numpy()
    return spark.sparkContext.broadcast(Bitmap(bits, words.view(np.uint64), probes))
