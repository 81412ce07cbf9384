"""Mixing sources to target weights by temperature (operator 3).

The sources' token shares are raised to an exponent between 1 (natural) and 0
(uniform).  The exponent is bisected to the largest at which the weights' entropy
meets the target, and back to the smallest at which no source is repeated more
often than allowed.  A source then gets its weight of the token budget as whole
epochs and a part of one more; each epoch is a fresh permutation of the source's
documents, dealt in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, token_counts, tokens

#: Documents to a block of a permutation, about.
BLOCK_DOCS = 10_000
#: The weights are found on the driver; more sources than this raise an error.
MAX_SOURCES = 1_000_000
#: Copies of a row that are made at once.
COPIES = 1000
_SPAN = float(1 << 62)


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised ``shares ** exponent``; sources without tokens stay at 0."""
    w = np.where(shares > 0, np.power(np.where(shares > 0, shares, 1.0), exponent), 0.0)
    return w / w.sum() if w.sum() else w


def find_exponent(totals: np.ndarray, budget: float, entropy_share: float | None, max_repeats: float | None, steps: int = 60) -> float:
    """The exponent in [0, 1].

    ``entropy_share``: the target as a share of the largest entropy possible (that
    of uniform weights); None asks for none.  ``max_repeats``: the most times that
    a source may be read within the budget; where it conflicts with the entropy it
    wins.  If even the natural shares break the limit, the exponent is 1.
    """
    if totals.sum() <= 0:
        return 1.0
    shares = totals / totals.sum()
    most = math.log(max(1, int((totals > 0).sum())))
    repeats = lambda a: float((tempered(shares, a)[totals > 0] * budget / totals[totals > 0]).max())

    def bisect(ok) -> float:
        """The largest exponent with ok, which holds from 0 up to some exponent."""
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    best = 1.0
    if entropy_share is not None and entropy(shares) < entropy_share * most:
        best = bisect(lambda a: entropy(tempered(shares, a)) >= entropy_share * most)
    if max_repeats is not None and repeats(best) > max_repeats:
        low = bisect(lambda a: repeats(a) > max_repeats)
        best = min(1.0, max(best, low + 2.0 ** -(steps - 4)))
    return best


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, seed: int = 17, tokenizer: str = tokens.DEFAULT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each chosen copy of a document.

    Columns: the id, ``source``, ``n_tokens``, ``epoch`` (from 0), ``block`` and
    ``position`` (from 1) in the source's permutation of that epoch, ``weight``
    (of the source) and ``exponent``.  ``budget`` is in tokens; None: as many as the
    table holds.  Whole epochs take every document; the last, partial one takes
    those that end within what is left of the source's tokens.

    A null source is a source of its own; null texts have no tokens; a source
    without any tokens gets weight 0 and no rows.  Rows that repeat are documents
    of their own.  An empty table gives an empty result.  Ties in the order fall
    to the smaller id.  ``row_col``, if given, tells rows of the same id or without
    one apart, and is returned too.  Other columns are ignored.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.when(F.col(id_col).isNull(), F.xxhash64(text_col))
    named = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"), row.alias("_row"))
    slim = scratch.stash(token_counts.token_lengths(named, tokenizer, ("_id", "_source", "_row"), "_text"), "lengths")

    sums = slim.groupBy("_source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy(F.col("_source").asc_nulls_first()).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = np.array([r["t"] or 0 for r in sums], float)
    goal = float(totals.sum() if budget is None else budget)
    exponent = find_exponent(totals, goal, entropy_share, max_repeats)
    weights = tempered(totals / totals.sum(), exponent) if totals.sum() else totals
    plan = []
    for r, t, w in zip(sums, totals, weights, strict=True):
        if t > 0:
            whole = int(goal * w // t)
            plan.append((r["_source"], whole, int(goal * w - whole * t), max(1, -(-r["n"] // BLOCK_DOCS)), float(w)))
    shape = f"_s {slim.schema['_source'].dataType.simpleString()}, _whole int, _left long, _blocks long, weight double"
    plan_df = F.broadcast(spark.createDataFrame(plan, shape))  # a row for each source; their number is checked above

    epochs = slim.join(plan_df, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole"))))
    # without an id the row, or its text, decides: those rows too spread over blocks
    drawn = F.when(F.col("_id").isNull(), F.xxhash64(F.lit(seed), "epoch", "_row")).otherwise(F.xxhash64(F.lit(seed), "epoch", "_id"))
    u = F.shiftrightunsigned(drawn, 2)
    dealt = epochs.withColumn("_u", u).withColumn("block", F.least(F.floor(F.col("_u") / F.lit(_SPAN) * F.col("_blocks")), F.col("_blocks") - 1))

    sums_by_block = dealt.filter("epoch = _whole").groupBy("_source", "epoch", "block").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums_by_block = sums_by_block.select(F.col("_source").alias("_bs"), F.col("epoch").alias("_be"), F.col("block").alias("_bb"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_source", "epoch", "block").orderBy("_u", F.col("_id").asc_nulls_last(), F.col("_row").asc_nulls_last())
    placed = dealt.withColumns({"position": F.row_number().over(order), "_run": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(sums_by_block, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("epoch") == F.col("_be")) & (F.col("block") == F.col("_bb")), "left")
    taken = placed.filter((F.col("epoch") < F.col("_whole")) | ((F.col("_left") > 0) & (F.col("_before") + F.col("_run") <= F.col("_left"))))
    return taken.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "n_tokens", "epoch", "block", "position", "weight", F.lit(exponent).alias("exponent"), *([F.col("_row").alias(row_col)] if row_col else []))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` chose it, whether its id is null or repeats.

    Rows that are equal in all columns but maps are interchangeable: they come as often
    as they were chosen together.  Rows of a source without tokens go; null and empty
    texts of other sources have no tokens and stay in every whole epoch.  Very long texts
    that exceed what is left of a budget are left out of its partial epoch.  An empty
    table stays empty.  Columns may have any names.
    """
    rows, names = scratch.positional(docs)
    compared = [names[c] for c, kind in docs.dtypes if "map<" not in kind]  # maps can't be hashed
    keyed = rows.withColumn("_row", F.concat(F.hex(F.xxhash64(*compared)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *compared))))
    chosen = mix(keyed, id_col=names[id_col], text_col=names[text_col], source_col=names[source_col], row_col="_row", **options)
    chosen = chosen.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    # equal rows are put together before the shuffle
    one = keyed.groupBy("_row").agg(F.first(F.struct(*names.values())).alias("_r")).join(chosen, "_row")
    many = one.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("_n") - F.col("_at")).cast("int"))))
    return many.select(*[F.col(f"_r.{n}").alias(c) for c, n in names.items()])
