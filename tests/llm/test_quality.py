import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    s = np.asarray(s)[order]
    k = np.arange(1, len(s) + 1.0)
    for v in np.unique(s):
        k[s == v] = k[s == v].mean()
    rank[order] = k
    y = np.asarray(y)
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 50 and auc([r.quality for r in held], [r.score for r in held]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.classify(docs, changed).collect()}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (None, "Some words.", "e"), (3, "x" * 200_000, "e"), (3, "x", "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    ids = [i for i in range(10, 40) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs = docs.union(spark.createDataFrame([(i, f"text {i}", "e") for i in ids], docs.schema))
    one = spark.createDataFrame([*[(i, 1) for i in ids], (ids[0], None), (None, 0), (7777, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, one).collect()
    assert len(rows) == 8 and all(r.score > 0.5 for r in rows)
    assert quality.classify(docs.limit(0), one).count() == 0
    assert quality.keep_good(docs, one).columns == docs.columns and quality.keep_good(docs, one).count() == 8


def test_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "é" * 10, "!!! ???", "\ud800", "a b " * 9):
        v = quality.statistics(t)
        assert len(v) == len(quality.FEATURES) and np.isfinite(v).all()


def walk(trees, row):
    total = trees.base
    for f, t, v in zip(trees.feature, trees.limit, trees.leaf, strict=True):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + (row[f[at]] > t[at])
        total += v[at - len(f)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_walk_equals_plain_walk():
    r = np.random.default_rng(0)
    x = r.standard_normal((1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:1000], y[:1000])
    got = trees.predict(x)
    assert ((got[1000:] > 0.5) == y[1000:]).mean() > 0.95
    assert got[:50] == pytest.approx([walk(trees, row) for row in x[:50]])


def plain_statistics(text):
    """The features by their definition, counted character by character and word by word."""
    raw = list((text or "").encode("utf-8", "surrogatepass"))
    words, lines = [[]], [[]]
    for b in raw:
        words[-1].append(b) if b not in (9, 10, 11, 12, 13, 32) else words.append([])
        lines[-1].append(b) if b != 10 else lines.append([])
    words, lines = [tuple(w) for w in words if w], [tuple(x) for x in lines if x]
    share = lambda test, of: sum(map(test, raw)) / max(1, of)
    n, w = len(raw), max(1, len(words))
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    pairs = {(words[k], words[k + 1]) for k in range(len(words) - 1)}
    return [
        np.log(1 + n), np.log(1 + len(words)), n / w, upper / max(1, upper + lower), share(lambda b: 48 <= b <= 57, n), share(lambda b: b in (32, 9), n), share(lambda b: b == 10, w),
        share(lambda b: b > 127, n), *[share(lambda b, m=m: b == m, w) for m in quality.MARKS], len(set(words)) / w, len(pairs) / max(1, w - 1), len(set(lines)) / max(1, len(lines)),
        np.log(1 + n / max(1, len(lines))), sum(65 <= x[0] <= 90 for x in words) / w, sum(x[-1] in quality.MARKS for x in words) / w,
    ]


def test_statistics_equal_plain_ones():
    r = np.random.default_rng(4)
    alphabet = list("aAbZ09 \t\n\r.,!?é日-_(") + ["the ", "Word. "]
    for _ in range(200):
        text = "".join(r.choice(alphabet, r.integers(0, 120)))
        assert quality.statistics(text) == pytest.approx(plain_statistics(text), abs=1e-12)


def plain_fit(x, y, trees, depth, rate, bins, ridge, least):
    """Boosting by trying every limit of every feature on the rows of every node; predictions for the rows."""
    base = np.log(y.mean() / (1 - y.mean()))
    limits = [sorted(set(np.quantile(x[:, j], [q / bins for q in range(1, bins)]).tolist())) for j in range(x.shape[1])]
    score = np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                g, h, best = (p - y)[rows], (p * (1 - p))[rows], (1e-9, None)
                for j in range(x.shape[1]):
                    for t in limits[j]:
                        left = x[rows, j] <= t
                        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                        if hl < least or hr < least:
                            continue
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, x[rows, j] <= t)
                split = best[1] if best[1] is not None else np.ones(len(rows), bool)
                below += [rows[split], rows[~split]]
            nodes = below
        for rows in nodes:
            if len(rows):
                score[rows] -= rate * (p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + ridge)
    return 1 / (1 + np.exp(-score))


def test_histogram_fit_equals_trying_every_limit():
    r = np.random.default_rng(12)
    x = r.standard_normal((160, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.standard_normal(160) > 0.4).astype(float)
    options = {"trees": 6, "depth": 3, "rate": 0.3, "bins": 8, "ridge": 1.0, "least": 2.0}
    assert quality.fit(x, y, **options).predict(x) == pytest.approx(plain_fit(x, y, **options), abs=1e-9)


def test_rows_of_repeated_ids_are_bounded(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"more {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in ids] + [(ids[1], float("nan")), (ids[2], float("inf")), (ids[3], 7.0)], "doc_id long, quality double")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or fit(x, y))
    trees = quality.train(docs, labels, 50)
    x, y = seen[0]
    assert len(x) <= 50 and np.isfinite(y).all() and (y >= 0).all() and (y <= 1).all() and np.isfinite(trees.predict(x)).all()
