"""Exact top-k search by Fagin's threshold algorithm (operator 4).

Every task cuts its vectors into blocks and sorts each block along every dimension,
once; the blocks are written.  Then batches of queries go over them: a query reads
its dimensions' lists from their better end in parallel, scores what it meets, and
stops when the best score still possible for an unseen vector is below its k-th
result.  That result goes with the query from block to block of a task, and each task
hands on k rows for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Vectors to a block at most, and components of a block and of a batch of queries, about.
VECTORS = 8192
BLOCK_COMPONENTS, BATCH_COMPONENTS = 1 << 20, 1 << 21
FIRST_DEPTH = 16


def usable(vector: Column) -> Column:
    """The components as doubles; null for vectors that take no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(True)), x)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: 64-bit integers, or Python integers where a component is too large for them."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    # doubles of this size are whole numbers
    whole = [int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


class Lists:
    """A block's vectors and their order along every dimension, from the smallest component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.ints = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable") if order is None else order
        self.most = max((int(abs(v)) for v in (vectors.max(), vectors.min())), default=0) if vectors.size else 0
        self.floats = vectors.astype(np.float64) if self.most < 1 << 53 else None

    def prepare(self, q: np.ndarray):
        """The query and the vectors in the narrowest arithmetic in which every score is exact."""
        reach = self.most * max((int(abs(v)) for v in q.tolist()), default=0) * max(1, len(q))
        if reach < 1 << 53:
            return self.floats, q.astype(np.float64)
        if reach < 1 << 63:
            return self.ints, q.astype(np.int64)
        return self.ints.astype(object), q.astype(object)

    def top(self, q: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best (smaller ids first among equals) of ``best`` and the block, and the depth that was read."""
        n = len(self.ids)
        used = np.flatnonzero(q != 0)
        values, q = self.prepare(q)
        seen = self.ids == own
        exact = object if values.dtype == object or (best is not None and best[1].dtype == object) else np.int64
        best_i, best_s = (np.zeros(0, np.int64), np.zeros(0, exact)) if best is None else (best[0], best[1].astype(exact))

        def add(rows: np.ndarray, s: np.ndarray) -> None:
            nonlocal best_i, best_s
            if len(best_s) == k and len(s):
                ok = s >= best_s[-1]
                rows, s = rows[ok], s[ok]
            if not len(s):
                return
            s, i = np.r_[best_s, s], np.r_[best_i, self.ids[rows]]
            first = np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x])), int) if exact is object else np.lexsort((i, -s))
            best_i, best_s = i[first[:k]], s[first[:k]]

        if not len(used):  # all scores are 0
            rows = np.flatnonzero(~seen)
            add(rows, np.zeros(len(rows), exact))
            return best_i, best_s, 0
        up = q[used] < 0  # from the smallest component on
        at, step = 0, FIRST_DEPTH
        while at < n:
            end = min(n, at + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[at:end, used[up]].ravel()] = True
            fresh[self.order[n - end : n - at, used[~up]].ravel()] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            add(rows, (values[rows] @ q).astype(exact))
            last = np.where(up, self.order[end - 1, used], self.order[n - end, used])
            bound = sum(int(v) * int(w) for v, w in zip(self.ints[last, used].tolist(), q[used].tolist(), strict=True))
            at, step = end, step * 2
            if len(best_s) == k and best_s[-1] > bound:
                break
        return best_i, best_s, at


_BLOCK = {"d": pa.int64(), "ids": pa.binary(), "x": pa.binary(), "order": pa.binary()}


def sorted_blocks(rows: DataFrame, vectors: int) -> DataFrame:
    """``id``, ``v`` in blocks with sorted lists: ``d`` (components), ``ids``, ``x`` (doubles), ``order``.

    A task cuts its rows as they come, by the number of components, so no key decides
    where a vector goes and nothing is shuffled.
    """

    def cut(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(d: int):
            ids, parts = held.pop(d)
            x = np.concatenate(parts)
            order = np.argsort(x, axis=0, kind="stable").astype(np.uint16) if d else np.zeros((len(x), 0), np.uint16)
            one = {"d": d, "ids": np.concatenate(ids).tobytes(), "x": x.tobytes(), "order": order.tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([one[c]], t) for c, t in _BLOCK.items()], names=list(_BLOCK))

        for b in batches:
            ids, v = b.column("id").to_numpy(zero_copy_only=False), b.column("v")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                x = flat[(ends[mine] - d)[:, None] + np.arange(d)]
                most = max(1, min(vectors, BLOCK_COMPONENTS // max(1, d)))
                at = 0
                while at < len(mine):
                    own = held.setdefault(d, ([], []))
                    room = most - sum(map(len, own[0]))
                    own[0].append(ids[mine[at : at + room]])
                    own[1].append(x[at : at + room])
                    at += room
                    if at <= len(mine) and sum(map(len, own[0])) >= most:
                        yield block(d)
            while sum(x.size for _, parts in held.values() for x in parts) > 2 * BLOCK_COMPONENTS:  # many different lengths
                yield block(max(held, key=lambda d: sum(x.size for x in held[d][1])))
        for d in list(held):
            yield block(d)

    return rows.mapInArrow(cut, "d long, ids binary, x binary, order binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = VECTORS, batch: int = BATCH_COMPONENTS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id, ``score`` of each query's k best.

    The queries are the rows of ``vectors`` for which ``is_query`` holds; candidates
    are all rows but those with the query's own id.  Equal scores go to the smaller
    id.  Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; vectors are scored against those of their own
    length only; empty ones score 0.  A query row that repeats is answered once;
    repeated candidates are candidates each.  With fewer candidates than k all are
    returned; an empty table gives an empty result.  Scores are exact for components
    of any size; a result whose score exceeds 64 bits raises an error.  Other columns
    are ignored, whatever their names.
    """
    if block > 1 << 16:
        raise ValueError("a block holds 65,536 vectors at most")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    asked = scratch.stash(rows.filter("q").select("id", "v").distinct(), "queries")
    lists = scratch.stash(sorted_blocks(rows.select("id", "v"), block), "lists")
    size = asked.agg(F.sum(F.size("v") + 1)).collect()[0][0] or 0
    batches, path = max(1, -(-size // batch)), scratch.new_path(spark, "found")
    for b in range(batches):
        # a batch of bounded size: no more than this is ever on the driver
        held = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(batches)) == b).toArrow()
        queries: dict[int, list] = {}
        for number, (key, v) in enumerate(zip(held.column("id").to_pylist(), held.column("v").to_pylist(), strict=True)):
            queries.setdefault(len(v), []).append((number * batches + b, key, floors(np.array(v, float), scale)))
        sent = spark.sparkContext.broadcast(queries)

        def search(batches, sent=sent):
            best: dict[int, tuple] = {}
            for frame in batches:
                for d, ids, x, order in zip(*(frame.column(c).to_pylist() for c in _BLOCK), strict=True):
                    mine = sent.value.get(d)
                    if mine is None:
                        continue
                    ids = np.frombuffer(ids, np.int64)
                    shape = (len(ids), d)
                    block = Lists(floors(np.frombuffer(x).reshape(shape), scale), ids, np.frombuffer(order, np.uint16).reshape(shape))
                    for number, key, q in mine:
                        found = block.top(q, key, k, best[number][1:] if number in best else None)
                        best[number] = (key, *found[:2])
            if best:
                out = [(key, number, int(i), int(s)) for number, (key, i_, s_) in best.items() for i, s in zip(i_, s_, strict=True)]
                if any(abs(s) >= 1 << 63 for *_, s in out):
                    raise OverflowError("a score exceeds 64 bits")
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "n", "id", "score"])

        lists.mapInArrow(search, "query_id long, n long, id long, score long").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("query_id long, n long, id long, score long").parquet(path)
    order = Window.partitionBy("query_id", "n").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
"""
