import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, near_dedup, skew

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((-1, len(s), -1, True) if i is None else (i, len(s), find(i), find(i) == i) for i, s in sets)


def run(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in near_dedup.near_dedup(df.repartition(3), percent).collect())
    assert got == brute(rows, percent)


def family(r, n, words, vocabulary=500):
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(9000))
    run(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four five"), (7, "One Two Three Four Five"), (8, long), (9, long + " more"), (10, "É a b c d"), (11, "é a b c d"), (None, "one two"), (12, "a\x1cb c d e f"), (13, "a b c d e f"), (14, "a a a a a a a"), (15, "a a a a a")])


@pytest.mark.parametrize("percent", [80, 85])
def test_families(spark, percent):
    r = random.Random(percent)
    texts = [t for n in (1, 2, 3, 8, 40) for t in family(r, n, r.choice([30, 80, 150]))] + [f"lone text number {i} of its own kind {i * 7}" for i in range(20)]
    texts += texts[:10]
    r.shuffle(texts)
    run(spark, list(enumerate(texts)), percent)


def test_blocks_of_large_buckets_and_clusters(spark, monkeypatch):
    r = random.Random(11)
    rows = list(enumerate(family(r, 60, 60) + family(r, 5, 60)))
    original = near_dedup.candidate_edges
    monkeypatch.setattr(near_dedup, "candidate_edges", lambda reps, percent, miss: original(reps, percent, miss, 7))
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 600)
    monkeypatch.setattr(near_dedup, "STAR_PART", 13)
    run(spark, rows)


def test_chains_in_large_clusters(spark, monkeypatch):
    """Links that only the pairs of blocks can find: the ends of a chain have nothing to do with its centre."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(90)]
    rows += [(1000 + i, " ".join([*words[:60], *(f"y{i}-{k}" for k in range(4))])) for i in range(20)]
    monkeypatch.setattr(near_dedup, "CLUSTER_DOCS", 8)
    monkeypatch.setattr(near_dedup, "STAR_PART", 5)
    run(spark, rows, 80)


def test_hubs_are_spread(spark):
    """The joins of a round give a hub's edges to many tasks."""
    edges = [(0, i) for i in range(1, 20_001)] + [(30_000 + i, 60_000) for i in range(20_000)]
    df = spark.createDataFrame(edges, "a long, b long")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        for frame, key, value in ((df, "b", "a"), (df.selectExpr("b as a", "a as b"), "b", "a")):
            small = frame.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
            met = skew.attach(frame, small, [key], "n", len(edges), F.col(value))
            sizes = [len(list(p)) for p in met.rdd.glom().map(len).map(lambda n: [0] * n).collect()]
            assert sum(sizes) == len(edges) and max(sizes) < len(edges) / 8
            assert met.filter("m is null").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (3, a), (3, b), (4, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_dedup(df).collect()} == {(i, 1) for i in (1, 2, 3, 4)}
    c = "other words that are in none of the texts before"
    more = df.union(spark.createDataFrame([(3, c), (9, c)], df.schema))  # an id with three texts
    assert {r.component_id for r in near_dedup.near_dedup(more).collect()} == {1}


def test_empty(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bounds():
    for percent, miss in ((85, 2e-5), (80, 2e-5)):
        rows, bands = near_dedup.plan(percent, miss)
        assert (1 - (percent / 100) ** rows) ** bands <= miss and rows * bands <= 168
        steps = near_dedup.least_matches(percent, miss, rows * bands)
        assert [n for n, _ in steps][-1] == rows * bands and all(m < n * percent / 100 for n, m in steps)
    same = np.arange(336, dtype=np.uint32).reshape(2, 168)
    i, j = np.divmod(np.arange(4), 2)
    assert len(near_dedup.survivors(same, same, i, j, 85, 2e-5)[0]) == 2


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_are_lost_with_the_chosen_probability(percent):
    rows, bands = near_dedup.plan(percent, 2e-5)
    live, at, s = np.array([1.0]), 0, percent / 100  # live[m]: probability of m matches and not dropped
    for n, least in near_dedup.least_matches(percent, 2e-5, rows * bands):
        for _ in range(n - at):
            live = np.r_[live * (1 - s), 0] + np.r_[0, live * s]
        live[:least], at = 0, n
    assert 0 < 1 - live.sum() <= 2e-5


def test_similar_pairs_share_signatures():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.r_[a[:1800], r.integers(0, 2**63, 200, dtype=np.uint64)]
    share = (near_dedup.signature(np.unique(a), 160) == near_dedup.signature(np.unique(b), 160)).mean()
    assert abs(share - 1800 / 2200) < 0.12


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5, 5), (7000, 7000)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for n in sorted(near):
        if n not in seen:
            stack, group = [n], set()
            while stack:
                x = stack.pop()
                if x not in group:
                    group.add(x)
                    stack += near[x]
            seen |= group
            want |= {x: n for x in group}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0
