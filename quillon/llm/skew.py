"""A join to one row per key that no hot key can stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


def attach(big: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, salt: Column) -> DataFrame:
    """``big`` with the other columns of ``small`` (nulls where a key isn't in it).

    ``small`` has one row for each key, and in ``count`` how many rows of ``big`` have
    it, of ``total`` rows or fewer.  Keys with more than one shuffle partition's share
    of them are no more than there are partitions; they alone are broadcast.  Their
    rows, and those with a null key, which meet nothing in the shuffled join, are
    spread there by ``salt``, which must depend on stored values only.
    """
    ranges = scratch.partitions(big.sparkSession)
    most = max(1, total // ranges)
    values = [c for c in small.columns if c not in keys]
    hot = small.filter(F.col(count) > most).select(*keys, F.struct(*values).alias("_hot"))
    # always 0, but no literal: the optimizer would make a filter of it and join by the keys alone
    zero = F.pmod(F.col(count).cast("long"), F.lit(1)).alias("_z")
    cold = small.filter(F.col(count) <= most).select(*keys, F.struct(*values).alias("_cold"), zero)
    flagged = big.join(F.broadcast(hot), keys, "left")  # at most ``ranges`` rows
    loose = F.col("_hot").isNotNull()
    for k in keys:
        loose = loose | F.col(k).isNull()
    met = flagged.withColumn("_z", F.when(loose, F.pmod(F.xxhash64(salt), F.lit(1 << 30)) + 1).otherwise(0)).join(cold, [*keys, "_z"], "left")
    both = F.coalesce("_hot", "_cold")
    return met.select(*big.columns, *[both[v].alias(v) for v in values])
