"""Bitmaps of hashed keys with a bounded number of bits: small enough to send to every task at any input size.

They only spare work: a clear bit proves that a key is absent, a set bit proves nothing, and the exact join
that follows decides.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
#: Bits of a bitmap that is sized for its keys: so many for each, up to a limit.
BITS_A_KEY, MOST_BITS = 8, 1 << 28


def bits_for(keys: int) -> int:
    """The power of two of bits, from ``BITS`` on, that leaves a bitmap of so many keys mostly clear, up to ``MOST_BITS``."""
    return min(max(MOST_BITS, BITS), max(BITS, 1 << (BITS_A_KEY * keys - 1).bit_length()))


def build(keys: DataFrame, key: str, bits: int = 0) -> np.ndarray:
    """Bitmap (as 64-bit words) of a column of 64-bit hashes, of ``BITS`` or so many bits; at most a 64th as many rows are collected."""
    bits = bits or BITS
    bit = F.col(key).bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({key} & 63 AS INT))")
    rows = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), one.alias("bits")).groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes may be present."""
    at = hashes & np.uint64(64 * len(words) - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def may_contain(words: np.ndarray, key: Column) -> Column:
    """``contains`` as a column, for a column of 64-bit hashes; set words travel as one literal, in their order."""
    used = np.flatnonzero(words)
    if not len(used):
        return F.lit(False)
    place = np.zeros(len(words), np.int64)
    place[used] = np.arange(1, len(used) + 1)

    def literal(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    bit = F.shiftright(key.bitwiseAND(F.lit(64 * len(words) - 1)), 6).cast("int")
    word = F.get(literal([0, *words[used].view(np.int64).tolist()]), F.get(literal(place.tolist()), bit).cast("int"))
    return F.call_function("shiftrightunsigned", word, key.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def hashed(column: Column) -> Column:
    return F.xxhash64(column)
