"""Filters evaluated over posting lists: relational plans instead of row predicates.

``match`` composes one tree from filters, unions, counted intersections and
anti-joins.  ``match_batch`` evaluates a whole batch of trees segment by segment, over
document bitmaps, with one shuffle however many and however high the trees are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .filters import And, Conjunction, MatchAll, Node, Not, Or, OrTerms, Term, Terms, flatten, terms, to_postorder

#: Documents to a segment of a batch, at most: neighbouring ids.
SEGMENT_DOCS = 65_536


def match(node: Node, postings: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the documents that match; ``postings`` has ``tag`` and the id, ``docs`` is the universe."""

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, parts)

    def build(n: Node) -> DataFrame:
        match n:
            case MatchAll():
                return docs.select(id_col).distinct()
            case Term(tag):
                return postings.filter(F.col("tag") == tag).select(id_col).distinct()
            case Terms(tags):
                return postings.filter(F.col("tag").isin(*tags)).select(id_col).distinct()
            case OrTerms(_):
                return build(flatten(n))
            case Or(parts):
                return union([build(p) for p in parts]).distinct()
            case And(parts):
                held = union([build(p).withColumn("_k", F.lit(k)) for k, p in enumerate(parts)])
                return held.groupBy(id_col).agg(F.count_distinct("_k").alias("_n")).filter(F.col("_n") == len(parts)).select(id_col)
            case Not(child):
                return docs.select(id_col).distinct().join(build(child), id_col, "left_anti")
            case Conjunction(groups):
                used = [terms(g) for g in groups if terms(g)]
                if not used:
                    raise ValueError("a conjunction needs a group that isn't empty")
                dealt = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.lit(t).alias("t")) for k, g in enumerate(used) for t in g]))
                wanted = docs.sparkSession.range(1).select(dealt.alias("x")).select("x.g", "x.t")
                held = postings.join(F.broadcast(wanted), F.col("tag") == F.col("t"))  # as many rows as the filter has tags
                return held.groupBy(id_col).agg(F.count_distinct("g").alias("_n")).filter(F.col("_n") == len(used)).select(id_col)
        raise TypeError(n)

    return build(node)


def match_batch(trees: dict[int, Node], postings: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``qid`` and the id of every match of every tree; ids are whole numbers.

    Postings and documents meet once, by segment: a task turns a segment's postings of
    the batch's tags into document bitmaps and runs the trees' post-order steps over
    them, so neither the plan nor the shuffle grows with the height of the trees, and a
    complement never leaves its segment.  Tags of no tree aren't shuffled.
    """
    steps = {q: to_postorder(flatten(t)) for q, t in trees.items()}
    wanted = sorted({t for tree in trees.values() for t in terms(tree)})
    segment = F.floor(F.col(id_col) / SEGMENT_DOCS).alias("_g")
    held = postings.filter(F.col("tag").isin(*wanted) if wanted else F.lit(False)).select(segment, F.col("tag").cast("long").alias("tag"), F.col(id_col).cast("long").alias("id"))
    every = docs.select(segment, F.col(id_col).cast("long").alias("id"))

    def run(entries: pa.Table, universe: pa.Table) -> pa.Table:
        ids = np.unique(universe.column("id").to_numpy())
        tag, at = entries.column("tag").to_numpy(), entries.column("id").to_numpy()
        place = np.minimum(np.searchsorted(ids, at), max(0, len(ids) - 1))
        known = ids[place] == at if len(ids) else np.zeros(len(at), bool)
        order = np.argsort(tag[known], kind="stable")
        tag, place = tag[known][order], place[known][order]

        def bits(t: int) -> np.ndarray:
            out = np.zeros(len(ids), bool)
            out[place[np.searchsorted(tag, t) : np.searchsorted(tag, t, "right")]] = True
            return out

        found = {q: ids[run_bitmaps(s, bits, len(ids))] for q, s in steps.items()}
        qid = np.repeat(np.fromiter(found, np.int64, len(found)), [len(x) for x in found.values()])
        return pa.table({"qid": pa.array(qid, pa.int64()), id_col: pa.array(np.concatenate([*found.values(), np.zeros(0, np.int64)]), pa.int64())})

    ship(docs.sparkSession)
    return held.groupBy("_g").cogroup(every.groupBy("_g")).applyInArrow(run, f"qid long, {id_col} long")


def run_bitmaps(steps: list[tuple], bits, n: int) -> np.ndarray:
    """The document bitmap that post-order steps give; ``bits(tag)`` is a tag's bitmap of ``n`` documents."""
    leaves: list[np.ndarray] = []
    stack: list[np.ndarray] = []
    union = lambda parts: np.logical_or.reduce([np.zeros(n, bool), *parts])
    for op, *counts in steps:
        if op == "POST":
            leaves.append(union([bits(t) for t in counts[0]]))
        elif op == "CONJUNCTION":
            own = leaves[len(leaves) - sum(counts) :]
            del leaves[len(leaves) - sum(counts) :]
            ends = np.cumsum(counts)
            stack.append(np.logical_and.reduce([union(own[e - c : e]) for e, c in zip(ends, counts, strict=True)]))
        else:
            a, b = counts
            own = leaves[len(leaves) - a :] + stack[len(stack) - b :]
            del leaves[len(leaves) - a :], stack[len(stack) - b :]
            stack.append(~own[0] if op == "NOT" else np.logical_and.reduce(own) if op == "AND" else union(own))
    return stack[0] if stack else leaves[0] if leaves else np.ones(n, bool)
