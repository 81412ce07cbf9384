"""Scoring in blocks against pair by pair, on odd rows, ties and several blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalogue
from quillon.functions import blocks
from quillon.operators import search

TEXTS = ["", "3", "3 AND 4", "1 OR 2", "NOT 5", "99", "(1 OR 2) AND NOT 3"]


def odd_rows(r, n, value):
    """Vectors with nulls, other lengths, values beyond half precision, infinite ones and none at all among common ones, each twice."""
    odd = [None, [], [None, 1.0, 2.0, 3.0], [1.0], [float("nan"), 0.0, 0.0, 1.0], [float("inf"), 0.0, 1.0, 1.0], [-70000.0, 1.0, 1.0, 1.0], [1e200, -1e200, 1.0, 1e200], [1e-200] * 4, [0.0, -0.0, 0.0, 0.0]]
    rows = [odd[k] if k < len(odd) else [value() for _ in range(4)] for k in range(n // 2)]
    return rows + rows[: n - len(rows)]


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.fixture
def small(monkeypatch):
    for name, n in (("PART", 16), ("QUERIES", 4), ("GROUP", 3), ("FEW", 2), ("HELD", 60), ("MANY", 30), ("PAIRS", 7)):
        monkeypatch.setattr(blocks, name, n)


@pytest.fixture
def tables(spark):
    r = random.Random(7)
    tags = lambda: sorted({r.randrange(8) for _ in range(r.randrange(5))}) or None
    docs = [(d if d != 50 else None, v, tags(), [0, 1, 2, None][d % 4]) for d, v in enumerate(odd_rows(r, 90, lambda: r.uniform(-1, 1)))]
    queries = [(q, v, TEXTS[q % 7], [0, 1, 5, 20, 40, 500][q % 6]) for q, v in enumerate(odd_rows(r, 40, lambda: r.uniform(-1, 1)))]
    queries += [(40, [0.5] * 4, None, None)]
    return spark.createDataFrame(docs, "doc_id long, vec array<double>, tags array<long>, shard_id int").repartition(3), spark.createDataFrame(queries, "qid int, vec array<double>, filter string, k int")


@pytest.mark.parametrize("f16", [True, False])
def test_odd_rows_rank_as_pair_by_pair(spark, tables, f16):
    docs, queries = tables
    for options in ({}, {"shard_col": "shard_id"}, {"shard_col": "shard_id", "ratio": 0.5}):
        want = search.topk_rows(docs, queries, f16, **options)
        got = search.topk(docs, queries, f16, **options)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert plain(got.collect()) == plain(want.collect())
    got = search.topk(docs, queries, f16, "shard_id", shards=[0, 2])
    assert plain(got.collect()) == plain(search.topk_rows(docs.filter("shard_id IN (0, 2)"), queries, f16, "shard_id").collect())


@pytest.mark.parametrize("f16", [True, False])
def test_odd_rows_score_as_pair_by_pair(spark, tables, f16):
    docs, queries = tables
    q = queries.drop("k").withColumn("k", F.lit(1))
    pairs = search.score(search.match(search.quantised(docs, f16), search.quantised(q, f16))).select(F.col("qid").cast("long").alias("qid"), "doc_id", "score")
    assert plain(search.scores(docs, q, f16).collect()) == plain(pairs.collect())
    want = {x.qid: (x.n, x.total) for x in pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).collect()}
    got = {x.qid: (x.pairs, x.total) for x in search.totals(docs, q, f16).collect()}
    assert got.keys() == want.keys()
    for qid, (n, total) in want.items():
        assert got[qid][0] == n and (got[qid][1] is None) == (total is None)
        assert total is None or got[qid][1] == pytest.approx(total, rel=1e-9, nan_ok=True)


def test_sums_in_order_are_kept():
    """Single-precision vectors: the matrix product's last bits must not show, in ties of copies as well."""
    r = np.random.default_rng(3)
    q, v = (r.standard_normal((n, 64)).astype(np.float32).astype(float) for n in (40, 300))
    want = np.array([[sum((a * b for a, b in zip(x, y, strict=True)), 0.0) for y in v] for x in q])
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    none = lambda m: np.zeros(len(m), bool)
    assert (blocks.scores_of(q, v, False, norm(q), norm(v), none(q), none(v), None) == want).all()
    assert (blocks.scores_of(q, v, False, norm(q), norm(v), none(q), none(v), 6) == blocks.rounded(want, 6)).all()


def test_halves_are_rounded_away_from_zero():
    s = np.array([0.0078125, -0.0078125, 2.5, 1e300, -1e-9, np.inf, np.nan])
    got = blocks.rounded(s, 6)
    assert got[:5].tolist() == [0.007813, -0.007813, 2.5, 1e300, 0.0] and got[5] == np.inf and math.isnan(got[6])


def test_small_blocks(small):
    """Several blocks, groups and hand-overs: the kernels alone, without Spark."""
    import pyarrow as pa

    r = random.Random(11)
    vec = pa.list_(pa.float64())
    docs = [(d, [float(r.randrange(3)) for _ in range(3)] if d % 9 else None, [r.randrange(6), None]) for d in range(100)]
    queries = [(q, [float(r.randrange(3)) for _ in range(3)], TEXTS[q % 5], [2, 7, 45][q % 3]) for q in range(11)]
    tables = (
        [pa.table({"doc_id": pa.array([x[0] for x in docs[lo : lo + 16]]), "vec": pa.array([x[1] for x in docs[lo : lo + 16]], vec), "tags": pa.array([x[2] for x in docs[lo : lo + 16]], pa.list_(pa.int64()))}) for lo in range(0, 100, 16)],
        [pa.table({"qid": pa.array([x[0] for x in queries[lo : lo + 4]]), "vec": pa.array([x[1] for x in queries[lo : lo + 4]], vec), "filter": [x[2] for x in queries[lo : lo + 4]], "k": [x[3] for x in queries[lo : lo + 4]], "keep": [x[3] for x in queries[lo : lo + 4]]}) for lo in range(0, 11, 4)],
    )

    def block(t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    pairs = [pa.RecordBatch.from_pydict({"d_number": [i], "d_block": [block(d)], "q_number": [j], "q_block": [block(q)]}) for i, d in enumerate(tables[0]) for j, q in enumerate(tables[1])]
    found = [x for b in blocks.block_best(True, False)(pairs) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    from quillon.plans import filters

    for q, v, text, k in queries:
        tree = filters.parse(text)
        match = [(d, None if w is None else sum(a * b for a, b in zip(w, v, strict=True))) for d, w, tags in docs if filters.evaluate(tree, set(tags) - {None})]
        want = sorted(match, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:k]
        got = sorted({(d, s) for i, _, d, s in found if i == q}, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:k]
        assert got == want


def block_of(table):
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def test_totals_need_no_pairs(monkeypatch):
    """Common vectors are summed up by block; only those that could overflow are scored pair by pair."""
    import pyarrow as pa

    r, scored, plainly = random.Random(5), [], blocks.scores_of
    monkeypatch.setattr(blocks, "scores_of", lambda q, v, *more: scored.append(len(q) * len(v)) or plainly(q, v, *more))
    docs = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(50)] + [[float("inf"), 0.0, 1.0, 1.0], [1.0] * 3]
    queries = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(20)] + [[float("nan")] * 4]
    vec = pa.list_(pa.float64())
    d = block_of(pa.table({"doc_id": range(52), "vec": pa.array(docs, vec), "tags": pa.array([[k % 2] for k in range(52)], pa.list_(pa.int64()))}))
    q = block_of(pa.table({"qid": range(21), "vec": pa.array(queries, vec), "filter": ["1" if k % 2 else "" for k in range(21)]}))
    pairs = pa.RecordBatch.from_pydict({"d_number": [0], "d_block": [d], "q_number": [0], "q_block": [q]})
    got = {x["qid"]: x for b in blocks.block_totals(False)([pairs]) for x in b.to_pylist()}
    for i, v in enumerate(queries):
        held = [w for k, w in enumerate(docs) if i % 2 == 0 or k % 2]
        want = sum(sum(a * b for a, b in zip(v, w, strict=True)) for w in held if len(w) == 4)
        assert got[i]["pairs"] == len(held) and got[i]["total"] == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert sum(scored) == 10 + 51  # the infinite vector with the queries that match all; the query without numbers with all of its length


#: The search queries whose pairs are scored in blocks.
IN_BLOCKS = ["inner_product", "score_only", "score_f16", "score_all_pairs", "truth_fp32", "recall_summary", "recall_at_k", "topk_shard_ratio", "topk_k_exceeds", "filtered_scores", "topk_sharded", "topk_filtered", "topk_per_query_k", "truth_batch", "topk_stream_merge", "truth_f16", "topk_partial_shards"]


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_pairs_are_scored_in_blocks(spark, sf_dir, name):
    """No operator of the plan sums up a pair in a row's expression, and only blocks meet in the nested-loop join."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "d_block" in plan and "q_block" in plan and "aggregate(zip_with" not in plan


def test_cached_truth_is_scored_in_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "score", None)  # pair by pair
    assert catalogue.QUERIES["truth_cache"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("f16", [True, False])
def test_large_results_rank_slice_by_slice(spark, tables, f16, monkeypatch):
    docs, queries = tables
    for name, n in (("PART", 16), ("SLICED", 3), ("LEAVE", 7)):
        monkeypatch.setattr(blocks, name, n)
    want = search.topk_rows(docs, queries, f16)
    got = search.topk(docs, queries, f16)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert plain(got.collect()) == plain(want.collect())
    assert "slice" in got._jdf.queryExecution().optimizedPlan().toString()
    again = queries.union(queries.filter("qid % 3 = 0"))  # ids that repeat are ranked together
    assert plain(search.topk(docs, again, f16).collect()) == plain(search.topk_rows(docs, again, f16).collect())
    monkeypatch.setattr(blocks, "SLICE", 50)  # more documents than a slice may hold
    assert plain(search.topk(docs, queries, f16).collect()) == plain(want.collect())


def test_exceeding_k_needs_no_window(spark, sf_dir):
    """Spark's window neither sorts nor ranks a result that holds nearly all pairs."""
    plan = catalogue.QUERIES["topk_k_exceeds"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "slice" in plan and "q_block" in plan


def test_scores_of_one_split_come_from_many_tasks(spark):
    """All pairs are dealt to all cores, however few splits the documents have."""
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.array(F.col("id") / 7.0).alias("vec"), F.array(F.lit(1).cast("long")).alias("tags"))
    queries = spark.createDataFrame([(q, [1.0], "") for q in range(3)], "qid long, vec array<double>, filter string")
    found = search.scores(docs, queries).withColumn("task", F.spark_partition_id())
    got = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks")).collect()[0]
    assert got.n == 15_000 and got.tasks > 1
