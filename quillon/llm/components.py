"""Connected components of an edge table, by alternating star operations.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest neighbour; the edges become stars in a logarithmic number of rounds.
Minima are aggregated map-side, hubs are split (see :mod:`.skew`), and every round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import attach


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _large(e: DataFrame, edges: int) -> DataFrame:
    """Every neighbour larger than the node goes to the smallest of node and neighbours."""
    near = _both(e)
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = attach(near.filter("v > u"), least, ["u"], "n", 2 * edges, F.col("v"))
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small(e: DataFrame, edges: int) -> DataFrame:
    """The node and its smaller neighbours go to the smallest of them; edges have a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = attach(e, least, ["b"], "n", edges, F.col("a")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.union(own).filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (``a``, ``b``).

    Loops, repeated and reversed edges do no harm; edges with a null end are left
    out.  No edges give an empty result.  Other columns are ignored.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    loops = edges.filter("a is not null and a = b").select(F.col("a").alias("node")).distinct()
    e = scratch.stash(e, "edges")
    before = _shape(e)
    for _ in range(most_rounds):
        # the operations never add edges, so the count bounds both
        e = scratch.stash(_small(_large(e, before[0]), before[0]), "stars")
        now = _shape(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    alone = loops.join(stars.union(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.union(roots).union(alone)


def _shape(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return tuple(r)
