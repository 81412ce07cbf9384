import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import bitmaps
from quillon.plans import filters as fl
from quillon.plans import postings_algebra

# what each expression means, written in Python's own logic over t, the tags
MEANING = {
    "12": lambda t: 12 in t,
    "12 AND 31": lambda t: 12 in t and 31 in t,
    "12 OR 31": lambda t: 12 in t or 31 in t,
    "NOT 31": lambda t: 31 not in t,
    "31 OR 12 AND 70": lambda t: 31 in t or (12 in t and 70 in t),
    "12 AND 70 OR 31 AND 200": lambda t: {12, 70} <= t or {31, 200} <= t,
    "NOT 12 OR 31": lambda t: 12 not in t or 31 in t,
    "NOT (12 OR 31) AND 70": lambda t: not t & {12, 31} and 70 in t,
    "(12 OR 70) AND (31 OR 200)": lambda t: bool(t & {12, 70}) and bool(t & {31, 200}),
    "NOT NOT NOT 70": lambda t: 70 not in t,
    "((12)) AND (((31 OR 31)))": lambda t: {12, 31} <= t,
    "NOT (12 AND NOT (31 OR NOT 70))": lambda t: 12 not in t or 31 in t or 70 not in t,
    " \t\r\n": lambda t: True,
    "127 AND 128 AND 191": lambda t: {127, 128, 191} <= t,
    "127 OR 128 OR 8191": lambda t: bool(t & {127, 128, 8191}),
    "8191 AND NOT 8190": lambda t: 8191 in t and 8190 not in t,
    "12 OR 900000": lambda t: 12 in t,
    "12 AND 900000": lambda t: False,
    "NOT 900000": lambda t: True,
    "70 AND 12 AND 70": lambda t: {12, 70} <= t,
}
BITS = 8192


def _tag_sets():
    r = random.Random(21)
    pool = [12, 31, 70, 127, 128, 191, 200, 8190, 8191]
    return [set(), set(pool), *({p} for p in pool), *(set(r.sample(pool, r.randint(2, 6))) for _ in range(25))]


CASES = [(text, tags, bool(test(tags))) for text, test in MEANING.items() for tags in _tag_sets()]
BAD = ["(12", "12)", "(12 OR 31", "( )", "OR 12", "12 OR", "12 31", "12 AND AND 31", "12 NOT 31", "NOT", "(NOT) 12", "12 or 31", "Not 12", "12 | 31", "12,31", "-4", str(2**64)]


@pytest.mark.parametrize("text", BAD)
def test_malformed(text):
    with pytest.raises(fl.FilterSyntaxError):
        fl.parse(text)


def test_all_evaluators_agree(spark):
    rows = [(i, t, sorted(tags), want) for i, (t, tags, want) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, expr string, tags array<bigint>, want boolean").withColumn("words", bitmaps.to_words(F.col("tags"), BITS))
    for text in dict.fromkeys(t for t, _, _ in CASES):
        tree = fl.parse(text)
        got = df.filter(df.expr == text).select("tags", "want", fl.to_column(tree).alias("a"), fl.to_bitmap_column(tree, "words").alias("b")).collect()
        for r in got:
            tags = set(r.tags)
            steps = fl.to_postorder(fl.flatten(tree))
            assert fl.check_postorder(steps)
            mapped = postings_algebra.run_bitmaps(steps, lambda t, tags=tags: np.array([t in tags]), 1)[0]
            ran = 1 in fl.run_postorder(steps, lambda t, tags=tags: {1} if t in tags else set(), {1})
            again = fl.evaluate(fl.parse(fl.to_source(tree)), tags)
            assert (r.a, r.b, fl.evaluate(tree, tags), fl.evaluate(fl.flatten(tree), tags), ran, again, mapped) == (r.want,) * 7, (text, tags)


def test_null_tags_match_not(spark):
    df = spark.createDataFrame([(1, None), (2, [3])], "i int, tags array<bigint>")
    assert [r.i for r in df.filter(fl.to_column(fl.parse("NOT 3"))).collect()] == [1]


def _random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        return fl.Term(r.randrange(8))
    kind = r.choice(["and", "or", "not"])
    if kind == "not":
        return fl.Not(_random_tree(r, depth - 1))
    parts = tuple(_random_tree(r, depth - 1) for _ in range(r.randint(2, 3)))
    return (fl.And if kind == "and" else fl.Or)(parts)


def test_posting_algebra_equals_predicates(spark):
    r = random.Random(5)
    docs = [(d, sorted({r.randrange(8) for _ in range(r.randrange(5))})) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, tags array<long>").cache()
    from quillon.operators import corpus

    entries = corpus.posting_docs(df).cache()
    trees = {q: _random_tree(r) for q in range(12)} | {90: fl.MatchAll(), 91: fl.Term(77), 92: fl.Not(fl.Term(77))}
    want = {(q, d) for q, t in trees.items() for d, tags in docs if fl.evaluate(t, set(tags))}
    assert {tuple(x) for x in postings_algebra.match_batch(trees, entries, df).collect()} == want
    for q in (0, 1, 2, 91, 92):
        got = {x.doc_id for x in postings_algebra.match(trees[q], entries, df).collect()}
        assert got == {d for p, d in want if p == q}


def test_special_nodes(spark):
    conj = fl.Conjunction((fl.Terms((1, 2)), fl.OrTerms(()), fl.Term(3)))
    held = {1: np.array([True, False, False]), 2: np.array([False, True, True]), 3: np.array([False, False, True])}
    assert postings_algebra.run_bitmaps(fl.to_postorder(conj), held.get, 3).tolist() == [False, False, True]
    assert fl.evaluate(conj, {2, 3}) and not fl.evaluate(conj, {1, 2})
    steps = fl.to_postorder(conj)
    assert fl.check_postorder(steps)
    assert fl.run_postorder(steps, {1: {5}, 2: {6, 7}, 3: {7}}.get, {5, 6, 7}) == {7}
    assert not fl.check_postorder([("POST", (1,)), ("AND", 2, 0)])
    assert not fl.check_postorder([("POST", (1,)), ("POST", (2,)), ("NOT", 2, 0)])
    assert not fl.check_postorder([("POST", (1,)), ("POST", (2,))])
    with pytest.raises(fl.FilterSyntaxError):
        fl.flatten(fl.Conjunction(()))


def test_prune_unknown_fields():
    a, b = fl.Term(1), fl.Term(2, "other")
    assert fl.prune(fl.And((a, b)), {"tags"}) == fl.And((a,))
    assert fl.prune(fl.Not(b), {"tags"}) is None
    assert fl.prune(fl.And((fl.Or((b,)), a)), {"tags"}) == fl.And((a,))
    with pytest.raises(KeyError):
        fl.prune(b, {"tags"}, "error")


def test_text_and_shape():
    t = fl.parse("1 OR 2 AND NOT 3")
    assert fl.to_text(t) == "(TAG(1) OR (TAG(2) AND NOT(TAG(3))))"
    assert fl.to_text(fl.parse("")) == "MATCH_ALL"
    assert fl.terms(fl.parse("1 AND (1 OR 2)")) == [1, 1, 2]
    assert fl.selectivity(fl.parse("1 OR NOT 2"), {1: 0.5, 2: 0.25}) == pytest.approx(1 - 0.5 * 0.25)
    assert fl.shape(t)["nodes"] == {"NOT": 1, "AND": 1, "OR": 1}


def test_many_filters_equal_few(spark, monkeypatch):
    """More filters than one predicate takes, and queries in several batches."""
    from quillon.operators import corpus, search

    r = random.Random(9)
    docs = spark.createDataFrame([(d, [float(d % 7), 1.0], sorted({r.randrange(9) for _ in range(r.randrange(5))}) if d % 11 else None) for d in range(80)], "doc_id long, vec array<double>, tags array<long>")
    texts = ["", "NOT 77", *(fl.to_source(_random_tree(r)) for _ in range(40))]
    queries = spark.createDataFrame([(q, [1.0, 0.5], t, 100) for q, t in enumerate(texts)], "qid long, vec array<double>, filter string, k int")
    plain = {tuple(x) for x in search.match(docs, queries).select("qid", "doc_id").collect()}
    assert plain == {(q, d.doc_id) for q, t in enumerate(texts) for d in docs.collect() if fl.evaluate(fl.parse(t), set(d.tags or []))}
    over = corpus.posting_docs(docs)
    assert {tuple(x) for x in search.match_postings(docs, over, queries).select("qid", "doc_id").collect()} == plain
    monkeypatch.setattr(search, "MAX_FILTERS", 3)
    monkeypatch.setattr(search, "BATCH", 15)
    many = search.match(docs, queries)
    assert {tuple(x) for x in many.select("qid", "doc_id").collect()} == plain and {"vec", "qvec", "k"} <= set(many.columns)
    assert {tuple(x) for x in search.match_postings(docs, over, queries).select("qid", "doc_id").collect()} == plain
