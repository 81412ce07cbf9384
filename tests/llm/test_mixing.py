from collections import Counter

from quillon.llm import mixing


def test_rows_without_id_and_with_the_same_id_are_mixed(spark):
    # equal lengths: half of the tokens are half of the rows
    rows = [(None, f"some words {k:03d}", "a") for k in range(100)] + [(7, f"same words {k:03d}", "a") for k in range(60)] + [(8, "equal words 000", "a")] * 3 + [(100 + k, f"more words {k:03d}", "a") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {r.n_tokens for r in mixing.mix(df).collect()}
    assert len(n) == 1
    out = {}
    for share in (0.5, 1, 2.5):
        got = Counter((r.doc_id, r.text) for r in mixing.mix_documents(df.repartition(3), budget=int(len(rows) * share) * min(n)).collect())
        assert abs(sum(got.values()) - int(len(rows) * share)) <= 1
        assert all(abs(got[r[0], r[1]] / (3 if r[0] == 8 else 1) - share) < 1 for r in rows)
        out[share] = got
    assert out[1] == Counter((i, t) for i, t, _ in rows)
    assert sum(k for (i, _), k in out[0.5].items() if i is None) > 25
    assert out[0.5] == Counter((r.doc_id, r.text) for r in mixing.mix_documents(df.repartition(7), budget=int(len(rows) * 0.5) * min(n)).collect())


def test_unique_ids_are_mixed_as_chosen(spark):
    df = spark.createDataFrame([(k, f"words {k % 37} " * (1 + k % 5), "ab"[k % 3 == 0]) for k in range(200)], "doc_id long, text string, source string")
    assert Counter(r.doc_id for r in mixing.mix_documents(df).collect()) == Counter(r.doc_id for r in mixing.mix(df).collect())
