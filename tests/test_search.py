import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import bitmaps, posting_codec, vectors
from quillon.operators import corpus, quality, search
from quillon.plans import filters
from quillon.streaming import ingest


def half(x: float) -> float:
    y = float(np.float16(x))
    return 0.0 if abs(x) < 2.0**-14 else y


def test_f16(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, 65504.0, 65519.9, 65520.0, -70000.0, 2.0**-14, 2.0**-14 * 0.99, 1 + 2**-11, 1 + 3 * 2**-11, 2049.0, 2051.0] + [r.uniform(-2, 2) * 10 ** r.randint(-5, 4) for _ in range(2000)]
    got = [x.y for x in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", vectors.f16(F.col("x")).alias("y")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        assert got == [half(x) for x in xs]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),)], "x double").select(vectors.f16(F.col("x")).alias("y")).collect()
    assert all(math.isnan(x.y) for x in odd)


def brute(docs, queries, f16=True):
    h = half if f16 else float
    out = []
    for q, v, text, k in queries:
        tree, found = filters.parse(text), []
        for d, w, tags in docs:
            if filters.evaluate(tree, set(tags or [])):
                s = 0.0
                for a, b in zip(w, v, strict=True):
                    s += h(a) * h(b)
                found.append((-s, d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("levels,f16", [(0, True), (0, False), (8, True), (3, True), (2, True)])
def test_topk_equals_brute_force(spark, levels, f16):
    r = random.Random(levels)
    value = (lambda: r.uniform(-1, 1)) if not levels else (lambda: r.randrange(levels) - 1.0)
    docs = [(d, [value() for _ in range(6)], sorted({r.randrange(12) for _ in range(r.randrange(5))}) or None) for d in range(300)]
    texts = ["", "3", "3 AND 4", "1 OR 2", "NOT 5", "99", "(1 OR 2) AND NOT 3"]
    queries = [(q, [value() for _ in range(6)], texts[q % 7], [5, 40, 5000][q % 3]) for q in range(14)]
    d = spark.createDataFrame(docs, "doc_id long, vec array<double>, tags array<long>").withColumn("shard_id", F.col("doc_id") % 3)
    q = spark.createDataFrame(queries, "qid long, vec array<double>, filter string, k int")
    want = brute(docs, queries, f16)
    for options in ({}, {"shard_col": "shard_id"}):
        got = sorted(tuple(x) for x in search.topk(d, q, f16, **options).collect())
        assert got == sorted(want)
    if f16:
        assert sorted(tuple(x) for x in search.topk_blocks(d.repartition(3), q).collect()) == sorted(want)
    folded = sorted(tuple(x) for x in ingest.fold_shards(d, q, "shard_id", [0, 1, 2], f16).collect())
    assert folded == sorted(want)


def test_group_limit_is_planned(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.array(F.rand(1), F.rand(2)).alias("vec"), F.array(F.lit(1).cast("long")).alias("tags"))
    q = spark.createDataFrame([(0, [1.0, 0.0], "1", 1500)], "qid long, vec array<double>, filter string, k int")
    plan = search.topk(d.limit(10_000), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_recall_and_truth(spark):
    exact = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "qid long, doc_id long")
    got = spark.createDataFrame([(1, 10), (2, 5), (3, 1)], "qid long, doc_id long")
    rows = {x.qid: (x.hits, x.expected, x.recall) for x in quality.recall(got, exact).collect()}
    assert rows == {1: (1, 2, 0.5), 2: (1, 1, 1.0)}
    s = quality.recall_summary(quality.recall(got, exact)).collect()[0]
    assert (s.queries, s.avg_recall, s.min_recall, s.below_one) == (2, 0.75, 0.5, 1)


def test_truth_cache(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0], [1])], "doc_id long, vec array<double>, tags array<long>")
    q = spark.createDataFrame([(0, [1.0], "", 1)], "qid long, vec array<double>, filter string, k int")
    p = quality.fingerprint(spark.createDataFrame([(1, "x")], "version int, corpus string")).collect()[0].fingerprint
    for _ in range(2):
        assert quality.cached_truth(d, q, f"file://{tmp_path}", p).collect()[0].doc_id == 1


def test_bitmaps(spark):
    df = spark.createDataFrame([([0, 5, 63, 64, 129, 130, 999],), ([],), (None,)], "p array<int>").withColumn("w", bitmaps.to_words(F.col("p"), 130))
    got = df.select(bitmaps.to_positions(F.col("w")).alias("x"), bitmaps.popcount(F.col("w")).alias("n"), bitmaps.to_positions(bitmaps.complement(F.col("w"), 130)).alias("c")).collect()
    assert got[0].x == [0, 5, 63, 64, 129] and got[0].n == 5
    assert set(got[0].c) == set(range(130)) - set(got[0].x)
    assert got[1].x == [] and len(got[1].c) == 130 and got[2].n == 0


def test_segments_shards_layouts(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0)).alias("vec"), F.array(F.col("id") % 2).alias("tags"))
    placed = corpus.with_segments(df, 4)
    assert [(x.segment_id, x.local_id) for x in placed.orderBy("doc_id").collect()][-1] == (2, 1)
    assert [x.s for x in df.select(corpus.shard_of(F.col("doc_id"), 10, 3).alias("s")).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    p = corpus.with_layout(corpus.build_postings(corpus.posting_docs(placed)), 4, 0.5)
    assert {x.layout for x in p.filter("hit_count = 2").collect()} == {"dense_bitmap"}  # exactly on the threshold
    assert {x.layout for x in p.filter("hit_count = 1").collect()} == {"packed"}
    rules = {x.rule: x.rows for x in corpus.violations(df.union(df.limit(1)), 1, 17, 10).collect()}
    assert rules == {"doc_id_repeated": 1, "document_count": 1, "segment_size": 1}


def test_index_round_trip(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.col("id") / 10.0).alias("vec"), F.array(F.col("id") % 3).alias("tags"))
    corpus.write_index(df, str(tmp_path / "i"), 16, 0.2)
    got = corpus.load_index(spark, str(tmp_path / "i"))
    assert got["documents"].count() == 40 and got["posting_docs"].count() == 40 and got["postings"].count() == 9


def test_cycle(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "qid long, t string")
    assert [x.t for x in search.cycle(q, 7).orderBy("qid").collect()] == list("abcabca")


def test_sql_functions(spark):
    vectors.register_sql(spark)
    r = spark.sql("SELECT dot_f64(array(1D, 2D), array(3D, 4D)) AS d, f16(1.0004D) AS h, tag_match(array(1L, 2L), array(1L), array(3L)) AS m, tag_match(NULL, array(1L), array(3L)) AS n").collect()[0]
    assert (r.d, r.h, r.m, r.n) == (11.0, half(1.0004), True, False)
    assert struct.calcsize("<e") == 2


@pytest.mark.parametrize("layout", list(posting_codec.CODES))
def test_posting_round_trip(layout):
    r = np.random.default_rng(5)
    for docs, hits in ((16, 0), (16, 16), (100, 7), (4096, 1), (4096, 300), (70_000, 20)):
        at = np.sort(r.choice(docs, hits, replace=False))
        raw = posting_codec.encode(r.permutation(np.r_[at, at[:3]]), docs, layout)
        kind, back = posting_codec.decode(raw)
        assert kind == layout and back.tolist() == at.tolist() and len(raw) % 4 == 0
        for bad in (raw[:-1], raw[:4], bytes([raw[0] ^ 1]) + raw[1:], raw[:3] + bytes([raw[3] | 0xF0]) + raw[4:]):
            with pytest.raises(ValueError):
                posting_codec.decode(bad)
    with pytest.raises(ValueError):
        posting_codec.encode([16], 16, layout)


def test_posting_bytes_by_hand():
    assert posting_codec.encode([0, 17], 32, "dense_bitmap").hex() == "02000000" + "04000000" + "0100" + "0200"
    assert posting_codec.encode([0, 17], 32, "sparse_bitmap").hex() == "02000010" + "0c000000" + "00000000" + "02000000" + "0100" + "0200"
    assert posting_codec.encode([0, 17], 32, "packed").hex() == "02000040" + "08000000" + "01000000" + "02000100"
    assert posting_codec.encode([1, 2], 4, "byte_map").hex() == "02000020" + "04000000" + "00010100"
    assert posting_codec.encode([9, 3], 16, "id_list").hex() == "02000030" + "08000000" + "03000000" + "09000000"
