"""The pipeline's stages against their operators and brute force, and the registered queries against SQL."""

import re
from collections import Counter

import duckdb
import pytest
from tests.test_catalogue import TABLES, rows

import corpus_pipeline
from quillon.llm import packing, quality, queries

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = con.execute(queries.ORACLES[name])
    want = rows([c[0] for c in rel.description], rel.fetchall())
    assert rows(df.columns, df.collect()) == want


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, kept[-1], TINY).write.parquet(path)
        kept.append(spark.read.parquet(path))
        assert k == 4 or kept[-1].columns == columns, name
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert set(ids[1]) == {i for i, p in scores.items() if p}

    texts = {r.doc_id: r.text or "" for r in kept[1].collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert set(ids[2]) == {min(g)[1] for g in groups.values()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, up = {i: shingles(texts[i]) for i in ids[2]}, {i: i for i in ids[2]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for a, i in enumerate(order):
        for j in order[:a]:
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert set(ids[3]) == {i for i in order if find(i) == i}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 5
    assert set(ids[5]) == set(ids[4])
    n = {r.doc_id: r.n for r in packing.pieces(kept[4].dropDuplicates(["doc_id"])).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    packed = kept[5].collect()
    assert sum(r.length for r in packed) == sum(n[i] * c for i, c in ids[4].items())
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, _kept boolean, _dedup_kept int, _row string, _n long, _c0 int, score double, kept int, epoch int"


def odd_rows():
    word = "some plain words that tell of a quiet morning by the river and of nothing else at all"
    rows = [(None, word), (None, word), (None, None), (1, None), (2, ""), (3, " \t"), (4, word), (4, word), (5, word + "."), (6, "x " * 120_000), (7, "one"), (8, "One"), (9, word * 3)]
    return [(i, t, "en", "ab"[k % 2] if k != 3 else None, None, None, 1, "r", 5, 0, 0.5, 2, 3) for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, k):
    """Null ids, texts and sources, ties, repeated rows, a very long text, no rows, and columns named like the operators' own."""
    stage, rows = corpus_pipeline.STAGES[k][1], odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    out = stage(spark, docs, TINY)
    assert stage(spark, docs.limit(0), TINY).count() == 0
    if k == 4:
        got = out.collect()
        ids = Counter(r.doc_id for r in got if r.piece == 0)
        assert ids == Counter(r[0] for r in rows) and sum(r.length for r in got if r.doc_id == 2) == 1
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    got = Counter(tuple(r) for r in out.collect())
    if k == 0:
        assert got <= Counter(rows)
    elif k == 1:
        groups = {}
        for r in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, str(r)))
        assert Counter(str(r) for r in got.elements()) == Counter(min(g)[3] for g in groups.values())
    elif k == 2:
        assert Counter((r[0], r[1]) for r in got.elements()) == Counter((r[0], r[1]) for r in rows if r[0] not in (5, 8))
    else:
        assert set(got) <= set(rows) and sum(got.values()) > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 0
