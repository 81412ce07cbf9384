import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fagin


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in ok if i % 5 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in fagin.top_k(df, F.col("vec_id") % 5 == 0, k, **sizes).collect())
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(f32, k)


@pytest.mark.parametrize("levels", [0, 2])
def test_against_brute_force(spark, levels):
    r = np.random.default_rng(levels)
    value = r.standard_normal((120, 6)) * 0.3 if not levels else r.integers(-1, levels, (120, 6)).astype(float)
    rows = [(int(i), v.tolist()) for i, v in enumerate(value)]
    run(spark, rows)
    run(spark, rows, block=13, batch=28)


def test_edge_cases(spark):
    rows = [(0, [0.0, 0.0]), (5, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (10, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (6, [1.0, 2.0]), (15, [2e5, -2e5])]
    run(spark, rows)
    run(spark, rows, k=1)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert fagin.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact(spark):
    run(spark, [(0, [1e6, 1.0]), (1, [5e5, 0.0]), (2, [2e6, 0.0])])
    rows = [(0, [1.0, 2.0**-8]), (1, [2.0**45 + 2.0**25, 3.0]), (2, [2.0**45, 1.0]), (3, [-(2.0**46), 0.0]), (4, [2.0**45, 5.0]), (5, [2.0**-8, 2.0**40])]
    run(spark, rows)
    run(spark, rows, block=2)
    # components and products beyond 64 bits, which none of the results are
    df = spark.createDataFrame([(0, [1e18, 0.0]), (1, [1e300, 1.0]), (2, [1.0, 0.0]), (5, [0.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        fagin.top_k(df, F.col("vec_id") == 0, 1).collect()
    got = [tuple(r) for r in fagin.top_k(df, F.col("vec_id") == 5, 1).collect()]
    assert got == [(5, 1, 1, 512 * 256)]


def test_many_lengths_and_batches(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), r.integers(-3, 4, i % 7).astype(float).tolist()) for i in range(150)]
    run(spark, rows, batch=40, block=9)


def test_stops_early():
    r = np.random.default_rng(3)
    v = (r.standard_normal((8000, 4)) * 100).astype(np.int64)
    lists = fagin.Lists(v, np.arange(8000))
    ids, scores, depth = lists.top(np.array([90, -40, 0, 10]), -1, 5)
    s = v @ np.array([90, -40, 0, 10])
    assert scores.tolist() == sorted(s.tolist(), reverse=True)[:5] and depth < 4000
