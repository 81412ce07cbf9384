import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import binary, text
from quillon.operators import corpus, quality, search, stats, synthetic, tables
from quillon.plans import filters
from quillon.plans.filters import FilterSyntaxError
from quillon.streaming import ingest


def test_dataset(spark, tmp_path):
    vec = (np.arange(20) * 0.5).reshape(5, 4)
    path = tmp_path / "d.bin"
    path.write_bytes(binary.encode_dataset(vec, [[d, 128 + d % 2] for d in range(5)], 130))
    rows = binary.read_dataset(spark, str(path), chunk=2).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(5)) and rows[3].vec == vec[3].tolist()
    assert rows[3].tags == [3, 129] and len(rows[0].tag_words) == 3
    some = binary.read_dataset(spark, str(path), offset=3, count=99).collect()
    assert sorted(r.doc_id for r in some) == [3, 4]
    with pytest.raises(binary.FormatError):
        binary.read_dataset(spark, str(path), offset=5)
    bad = tmp_path / "bad.bin"
    bad.write_bytes(b"NOTMAGIC" + bytes(64))
    with pytest.raises(binary.FormatError, match="bad magic"):
        binary.read_dataset(spark, str(bad))
    with pytest.raises(binary.FormatError, match="cannot open"):
        binary.read_dataset(spark, str(tmp_path / "none.bin"))


def test_fvecs(spark, tmp_path):
    a = [[r * 10 + d for d in range(4)] for r in range(3)]
    b = [[r * 100 + d for d in range(3)] for r in range(2)]
    assert binary.decode_fvecs(binary.encode_fvecs(a))[2][3] == 23
    assert binary.decode_fvecs(binary.encode_fvecs(b, False))[1][2] == 102
    assert binary.decode_fvecs(binary.encode_fvecs([list(range(k * 64, k * 64 + 64)) for k in range(5)]))[-1][-1] == 319
    with pytest.raises(binary.FormatError):
        binary.decode_fvecs(b"\0\0\0\0")
    assert isinstance(binary.decode_fvecs(binary.encode_fvecs(a)[:24]), list)
    (tmp_path / "q.fvecs").write_bytes(binary.encode_fvecs(a))
    assert [r.vec[0] for r in binary.read_fvecs(spark, str(tmp_path / "q.fvecs")).orderBy("qid").collect()] == [0.0, 10.0, 20.0]


def test_records(spark, tmp_path):
    rows = [(0, b""), (1, b"hello"), (12345678901, b"\x00\x01\xff\x00a"), (4294967296, b"x" * 300)]
    raw = binary.encode_records(rows)
    assert binary.decode_records(raw) == rows
    with pytest.raises(binary.FormatError):
        binary.decode_records(raw[:-1])
    (tmp_path / "r").write_bytes(raw)
    assert [(r.id, bytes(r.payload)) for r in binary.read_records(spark, str(tmp_path / "r")).collect()] == rows


def test_tag_map(spark, tmp_path):
    tags = {"lang#fr": 3, "kind#é": 7}
    raw = binary.encode_tag_map(tags)
    assert binary.decode_tag_map(raw) == tags
    assert binary.decode_tag_map(raw[:4] + raw[8:]) == tags
    with pytest.raises(binary.FormatError):
        binary.decode_tag_map(raw + b"x")
    (tmp_path / "t").write_bytes(raw)
    assert {(r.section, r.tag_id) for r in binary.read_tag_map(spark, str(tmp_path / "t")).collect()} == {("lang", 3), ("kind", 7)}


def test_filter_and_topk_files(spark, tmp_path):
    f = tmp_path / "filters.txt"
    f.write_text("1 AND 2 \r\n\nNOT 3\n")
    assert [(r.fid, r.expr) for r in text.read_filters(spark, str(f)).orderBy("fid").collect()] == [(0, "1 AND 2"), (1, ""), (2, "NOT 3")]
    assert [(r.fid, r.expr) for r in text.read_filters(spark, str(f), keep_blank=False).orderBy("fid").collect()] == [(0, "1 AND 2"), (1, "NOT 3")]
    f.write_text("1 AND\n")
    with pytest.raises(FilterSyntaxError):
        text.read_filters(spark, str(f))
    k = tmp_path / "k.txt"
    k.write_text("5\n\n 7 \n9\n")
    assert [(r.qid, r.k) for r in text.read_topk(spark, str(k), 2).orderBy("qid").collect()] == [(0, 5), (1, 7)]
    with pytest.raises(ValueError):
        text.read_topk(spark, str(k), 4)
    k.write_text("0\n")
    with pytest.raises(ValueError):
        text.read_topk(spark, str(k), 1)
    q, fids = spark.range(4).withColumnRenamed("id", "qid"), spark.range(3).withColumnRenamed("id", "fid")
    assert text.assign_filters(q, fids).count() == 4


def test_query_records(spark, tmp_path):
    rec = {"result_num": 2, "main_tier": {"json_query": json.dumps({"vector": {"relevance_learning2rank": [1, 2], "syntax_filter": {"term": {"a": "x"}}}})}}
    whole, lines = tmp_path / "w.json", tmp_path / "l.json"
    whole.write_text(json.dumps([rec, 5, rec]))
    lines.write_text(json.dumps(rec) + "\nnot json\n\n" + json.dumps(rec | {"result_num": 0}) + "\n")
    assert text.read_query_records(spark, str(whole)).count() == 2
    got = text.extract_queries(text.read_query_records(spark, str(lines)), {"a#x": 4}, 2).orderBy("line").collect()
    assert [(r.line, r.filter, r.k, r.problem is None) for r in got] == [(0, "4", 2, True), (1, None, None, False), (3, None, None, False)]
    with pytest.raises(Exception, match="line"):
        text.extract_queries(text.read_query_records(spark, str(lines)), {}, 2, strict=True).collect()
    good = spark.createDataFrame([(0, [1.0], "4", 2)], "line long, vec array<double>, filter string, k long")
    out = tmp_path / "out"
    text.write_queries(good, str(out), {"name": "x"})
    assert not (out / "skipped_warnings").exists()
    text.write_queries(text.extract_queries(text.read_query_records(spark, str(lines)), {"a#x": 4}, 2), str(out), {"name": "x"})
    told = json.loads(spark.read.text(str(out / "manifest")).collect()[0][0])
    assert told == {"name": "x", "query_count": 1, "vector_dim": 2, "skipped_query_count": 2, "topk_min": 2, "topk_max": 2}
    assert [r.expr for r in text.read_filters(spark, str(out / "filters")).collect()] == ["4"] and text.read_topk(spark, str(out / "topk"), 1).collect()[0].k == 2
    assert [r[0][:7] for r in spark.read.text(str(out / "skipped_warnings")).collect()] == ["line 1:", "line 3:"]
    with pytest.raises(ValueError, match="no valid"):
        text.write_queries(good.withColumn("problem", F.lit("bad")), str(tmp_path / "none"), {})
    text.write_tsv(good.select("line", "k"), str(tmp_path / "tsv"), ["line"])
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).collect()[0].k == "2"


def test_repository(spark):
    repo, df = tables.TableRepository(spark), spark.range(3)
    a = repo.create("t", "1", df)
    assert repo.create("t", "1", spark.range(9)) is a and repo.get("t", "1").count() == 3
    repo.create("t", "2", df)
    assert spark.table("t_2").count() == 3
    assert repo.remove_unused({"t": {"2"}}) == [("t", "1")] and repo.get("t", "1") is None
    repo.remove("t", "1")
    repo.remove("t", "2")
    assert not spark.catalog.tableExists("t_2")


def test_synthetic_is_the_same_for_any_partitioning(spark):
    one = synthetic.corpus(spark, 50, 4, 30, 5, partitions=1).orderBy("doc_id").collect()
    assert one == synthetic.corpus(spark, 50, 4, 30, 5, partitions=7).orderBy("doc_id").collect()
    assert all(len(set(r.tags)) == 5 and all(-1 <= x < 1 for x in r.vec) for r in one)


def test_banded_frequencies(spark):
    rows = synthetic.banded_corpus(spark, 3000, 4, [(5, 0.9, 1.0), (20, 0.2, 0.3), (100, 0.001, 0.01)], rich_share=0.0)
    n = {r.tag: r.n / 3000 for r in rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(0.87 < n[t] <= 1 for t in range(5)) and all(0.15 < n[t] < 0.35 for t in range(5, 25)) and all(n.get(t, 0) < 0.03 for t in range(25, 125))
    rich = synthetic.banded_corpus(spark, 3000, 4, [(20, 0.1, 0.1)], rich_share=1.0).agg(F.avg(F.size("tags"))).collect()[0][0]
    assert 20 * 0.1 * 2.5 < rich < 20 * 0.1 * 9


def test_synthetic_queries(spark):
    docs = synthetic.banded_corpus(spark, 4000, 4)
    freq = docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("doc_freq"))
    rows = synthetic.queries(spark, 30, 4, freq, 4000, target=0.1, groups=1).collect()
    held = {r.tag for r in freq.collect()}
    used = [filters.terms(filters.parse(r["filter"])) for r in rows]
    hit = [search.match(docs, spark.createDataFrame([r])).count() / 4000 for r in rows[:3]]
    assert len(rows) == 30 and all(0.02 < h < 0.3 for h in hit)
    absent = sum(t not in held for u in used for t in u) / sum(map(len, used))
    assert 0.4 < absent < 0.8
    none = freq.filter("tag < 0")
    assert {r["filter"] for r in synthetic.queries(spark, 3, 4, none, 4000).collect()} == {""}
    common = freq.filter("doc_freq > 3000")
    assert all(len(filters.terms(filters.parse(r["filter"]))) >= 1 for r in synthetic.queries(spark, 3, 4, common, 4000).collect())
    for r in synthetic.grouped_queries(spark, 5, 4, 500).collect():
        assert r["filter"].count(" AND ") == 5 and r["filter"].count("NOT") == 1 and max(filters.terms(filters.parse(r["filter"]))) < 500
    sections = {"a": (0, 200), "b": (200, 200), "c": (400, 50), "d": (450, 10), "e": (460, 1)}
    for r in synthetic.section_queries(spark, 5, 4, sections, ["a", "c"], ["d", "e"], {"a": "b"}, resolved=0.5, clauses=2).collect():
        first, d, e, out = r["filter"].split(" AND ")
        tags = filters.terms(filters.parse(first))
        assert {t + 200 for t in tags if t < 200} == {t for t in tags if 200 <= t < 400} and any(t >= 461 for t in tags)
        assert {"460"} in [set(x.strip("()").split(" OR ")) for x in (d, e)] and out.startswith("NOT (")


def test_latency_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5, 7, [1.0, 2.0], 0.25), (0, 1.0, 3, [0.5, 0.125], 0.5)], "idx long, ms double, topk int, shard_ms array<double>, merge_ms double").withColumn("total_ms", F.col("ms"))
    read = lambda name: [tuple(r) for r in spark.read.csv(str(tmp_path / name), sep="\t", header=True).orderBy("idx").collect()]
    text.write_latencies(rows, str(tmp_path / "q"))
    assert read("q") == [("0", "1.0000", "3"), ("1", "2.5000", "7")]
    text.write_shard_latencies(rows, str(tmp_path / "s"), 2)
    assert read("s")[1] == ("1", "1.0000", "2.0000", "2.0000", "0.2500", "2.5000")
    text.write_shard_latencies(rows, str(tmp_path / "one"), 1)
    assert not (tmp_path / "one").exists()


def test_ingest(spark, tmp_path):
    src, schema = str(tmp_path / "src"), spark.createDataFrame([], "key long, v string, version long").schema
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(src)
    args = (src, schema, str(tmp_path / "t"), str(tmp_path / "c"), ["key"], "version")
    ingest.ingest(spark, *args)
    spark.createDataFrame([(1, "new", 2)], schema).write.mode("append").parquet(src)
    assert sorted((r.key, r.v) for r in ingest.ingest(spark, *args).collect()) == [(1, "new"), (2, "b")]


def test_open_loop_models_agree(spark):
    s = spark.createDataFrame([(lane, i, float((i * 37 + lane) % 11 * 20)) for lane in range(2) for i in range(40)], "lane long, i long, service_ms double")
    a = {(r.lane, r.i): round(r.latency_ms, 6) for r in ingest.open_loop(s, 12.0).collect()}
    assert a == {(r.lane, r.i): round(r.latency_ms, 6) for r in ingest.open_loop_sql(s, 12.0).collect()}


def test_percentiles_and_break_even(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    r = stats.order_percentiles(df, "v", {"a": 0.5, "b": 0.99, "c": 0.0}).collect()[0]
    assert (r.a, r.b, r.c) == (5.0, 9.0, 0.0)
    assert stats.break_even_units(100.0, 10.0, 50.0, 1000.0, 20.0) == pytest.approx(20.0)
    same = stats.fixed_histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).collect()
    assert [(x.bucket, x.n) for x in same] == [(0, 2)]
    assert df.select(F.max("v")).collect()[0][0] == 9.0


def test_checked_records(spark):
    inner = lambda v: {"json_query": json.dumps({"vector": {"relevance_learning2rank": v}})}
    records = [{"result_num": 3, "main_tier": inner([1.0, 2.0])}, {"result_num": 0, "main_tier": inner([1.0, 2.0])}, {"main_tier": inner([1.0, 2.0])}, {"result_num": 5, "main_tier": {}}, {"result_num": 7, "main_tier": inner([1.0])}]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "line long, record string")
    got = [tuple(r) for r in text.checked_records(rows, 2).orderBy("line").collect()]
    assert got == [(0, 3, 2, True), (1, 0, 2, False), (2, None, 2, False), (3, 5, None, False), (4, 7, 1, False)]


def test_written_files(spark, tmp_path):
    docs = spark.range(25).selectExpr("id as doc_id", "array(id * 0.5, 1.0) as vec", "if(id % 5 = 0, null, array(id, 70)) as tags")
    folder = f"file://{tmp_path}/d"
    assert binary.write_datasets(docs, folder, 71, 10) == 3
    got = {r.doc_id: (r.vec, r.tags) for r in binary.read_datasets(spark, folder, 4).collect()}
    assert got == {i: ([i * 0.5, 1.0], [] if i % 5 == 0 else [i, 70]) for i in range(25)}
    with pytest.raises(Exception, match="consecutive"):
        binary.write_datasets(docs.filter("doc_id <> 13"), f"file://{tmp_path}/gap", 71, 10)
    rows = spark.createDataFrame([(i, None if i == 3 else bytes([i]) * 40) for i in range(10)] + [(7, b"again")], "id long, payload binary")
    binary.write_records(rows, f"file://{tmp_path}/r", 100)
    back = sorted((r.id, bytes(r.payload)) for r in binary.read_records(spark, f"file://{tmp_path}/r").collect())
    assert back == sorted([(i, b"" if i == 3 else bytes([i]) * 40) for i in range(10)] + [(7, b"again")])
    assert len(list((tmp_path / "r").glob("*.rec"))) >= 3
    with pytest.raises(ValueError):
        binary.write_tag_map(spark.createDataFrame([], "term string, tag_id long"), f"file://{tmp_path}/t")


def test_compiled_filters(spark):
    rows = spark.createDataFrame([(0, "3 AND NOT (4 OR 4)"), (1, None), (2, "AND"), (3, "7")], "qid long, filter string")
    got = {r.qid: r for r in quality.compiled(rows).collect()}
    assert (got[0].ast, got[0].depth, got[0].refs, got[0].tags, got[0].sound) == ("(TAG(3) AND NOT((TAG(4) OR TAG(4))))", 4, 3, 2, True)
    assert got[1].ast == got[1].postorder == "MATCH_ALL" and got[3].postorder == "{7}"
    assert got[2].ast is None and got[2].problem and got[2].sound is None
    assert {(x.op, x.nodes) for x in got[0]["shape"]} == {("AND", 1), ("NOT", 1)}
    assert quality.compiled(rows.limit(0)).collect() == []


def test_numbered_rows(spark):
    rows = [("a" if i % 3 else None, i * 7) for i in range(40)] + [("a", None)]
    got = corpus.numbered(spark.createDataFrame(rows, "lane string, key long"), "key", ["lane"], width=10).collect()
    for lane in ("a", None):
        keys = sorted((r.key for r in got if r.lane == lane), key=lambda k: (k is not None, k))
        assert [r.key for r in sorted((r for r in got if r.lane == lane), key=lambda r: r.i)] == keys
        assert sorted(r.i for r in got if r.lane == lane) == list(range(len(keys)))
    assert corpus.numbered(spark.createDataFrame([], "key long"), "key").collect() == []


def test_open_loop_ranges(spark):
    rows = [(lane, i, float((i * 37 + len(lane)) % 23)) for lane in ("x", "yy") for i in range(50)]
    service = spark.createDataFrame(rows, "lane string, i long, service_ms double")
    walked = {(r.lane, r.i): r.end_ms for r in ingest.open_loop(service, 90.0).collect()}
    for width in (1, 7, 1000):
        summed = {(r.lane, r.i): r.end_ms for r in ingest.open_loop_sql(service, 90.0, width=width).collect()}
        assert summed == pytest.approx(walked)
