"""Bitmaps as arrays of 64-bit words: tag words and document bitmaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def words_for(bits: int) -> int:
    return -(-bits // WORD)


def to_words(positions: Column, bits: int) -> Column:
    """The words of a set of positions below ``bits``; others are ignored."""
    kept = F.filter(F.array_distinct(F.coalesce(positions.cast("array<int>"), F.array().cast("array<int>"))), lambda p: (p >= 0) & (p < bits))
    return F.transform(
        F.sequence(F.lit(0), F.lit(words_for(bits) - 1)),
        lambda w: F.aggregate(F.filter(kept, lambda p: F.shiftright(p, 6) == w), F.lit(0).cast("bigint"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(63)))),
    )


def to_positions(words: Column) -> Column:
    """The positions of the set bits, in order."""
    per = F.transform(words, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(w, b) == 1), lambda b: (b + i * WORD).cast("bigint")))
    return F.flatten(per)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("bigint")).bitwiseAND(F.coalesce(y, F.lit(0).cast("bigint"))))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("bigint")).bitwiseOR(F.coalesce(y, F.lit(0).cast("bigint"))))


def complement(words: Column, bits: Column | int) -> Column:
    """All other positions below ``bits``; the last word's padding stays clear."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    full = F.lit(-1).cast("bigint")

    def flip(w: Column, i: Column) -> Column:
        left = F.least(F.greatest(bits - i * WORD, F.lit(0)), F.lit(WORD)).cast("int")
        mask = F.when(left == WORD, full).when(left == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", full, F.lit(WORD) - left))
        return F.bitwise_not(w).bitwiseAND(mask)

    return F.transform(words, flip)
