import random
import re

from quillon.llm import exact_dedup


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        members.sort()
        for n, (_, _, _, k) in enumerate(members):
            out.append((rows[k][0], rows[members[0][3]][0], len(members), n == 0, norm))
    return out


def run(spark, rows, **more):
    import hashlib

    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, _norm string, keep_id int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df.repartition(5), **more).collect())
    want = sorted((i if i is not None else -1, k if k is not None else -1, n, kept, hashlib.sha256(norm.encode()).hexdigest()) for i, k, n, kept, norm in brute(rows))
    assert got == want


def test_edge_cases(spark):
    run(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "ab c"), (5, "a bc"), (6, "abc "), (7, "\u00a0abc"), (8, "x" * 100_000), (9, " " + "x" * 100_000), (None, "abc"), (10, "y"), (10, "y"), (11, "日本 語"), (12, "日本語")])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).count() == 0


def test_hot_texts_are_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 3)
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "h ot ", "ho t"]) if i % 3 else f"text {r.randrange(60)}") for i in range(600)]
    run(spark, rows)


def test_null_ties_with_empty(spark):
    run(spark, [(1, None), (2, ""), (3, "a"), (4, ""), (5, None)])


def test_null_ties_with_empty_in_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 3)
    run(spark, [(i, "" if i % 2 else None) for i in range(200)] + [(1000 + i, f"text {i}") for i in range(50)])


def test_shared_prefix(spark):
    run(spark, [(i, "same beginning of every text " * 3 + str(i % 40)) for i in range(200)])


def test_carry_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "s", 3), (2, "a ", "t", 4), (3, None, None, None)], "doc_id long, text string, source string, kept int")
    out = exact_dedup.exact_dedup(df, carry=df.columns, prefix="_x_")
    rows = {r.doc_id: r for r in out.filter("_x_kept").select(*df.columns).collect()}
    assert set(rows) == {2, 3} and rows[2].kept == 4 and rows[3].text is None


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan
