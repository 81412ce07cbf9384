import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return (sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


TEXTS = ["a.b@c.de x@y z@@q.w a@b.c@d.e", "é@b.co mail me+1@x-y.co.uk.", "1.2.3.4.5.6 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111x", "+1 (988) 555-2485 +123 +1234567890123456 ++1 2345678 9", "@", "a@", "@b.c", "a@b.c.", "日本 4111111111111111", "1" * 30 + ".2.3.4"]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1245.@+- ()%é", max_size=40))
def test_base_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a@b.cd", 1), (3, "a@b.cd", 1), (3, "a@b.cd", 1)], "doc_id long, text string, spans int")
    rows = pii.sanitise(df).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans, r.sanitised or "") for r in rows) == [(0, 1, "email:0:6", "[EMAIL]"), (1, 0, "", ""), (2, 0, "", ""), (3, 1, "email:0:6", "[EMAIL]"), (3, 1, "email:0:6", "[EMAIL]")]
    assert {r.base_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert pii.sanitise(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    texts = [f"Zanzibar clerk number {w} wrote jo@x.example about things" for w in ("ape", "bee", "cat", "dog")]  # in every text with the entity, and nowhere else
    texts += [f"some things about other {w} number {w}" for w in ("elk", "fox", "gnu", "hen", "ibis", "jay", "koi")]
    texts += [texts[0]] * 3  # copies are one text for the support
    texts += ["rare amy@y.example words"] * 5  # several rows, one text: no support
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(df, share=0.8, remove=0.97, support=3).collect()}
    flagged = {texts[0][int(s):int(e)] for k, s, e in (x.split(":") for x in rows[0].spans.split(",")) if k == "remove"}
    assert flagged == {"Zanzibar", "clerk", "wrote"}
    assert rows[0].n_terms == 3 and rows[0].sanitised == "  number ape  [EMAIL] about things"
    assert rows[4].spans == "" and rows[4].sanitised is None
    last = rows[len(texts) - 1]
    assert last.spans == "email:5:18" and last.n_terms == 0
    lower = {r.doc_id: r for r in pii.sanitise(df, share=0.2, remove=0.97, support=3).collect()}
    assert "[TERM]" in lower[0].sanitised


def rated_by_brute_force(texts, share, remove, support):
    """Flagged terms of each text: every entity with every term of its texts."""
    found = [({pii.entity(k, t[s:e]) for k, s, e in pii.base_spans(t)}, {w for w, _, _ in pii.masked_terms(t, pii.base_spans(t))}) for t in texts]
    words = Counter(w for t in texts for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
    out = [{} for _ in texts]
    for e in {e for es, _ in found for e in es}:
        own = [k for k, (es, _) in enumerate(found) if e in es]
        for w in {w for k in own for w in found[k][1]}:
            both = [k for k in own if w in found[k][1]]
            different = len({texts[k] for k in both})
            short = max(support - different, 0) * len(both) / different
            prior = len(own) / len(texts)
            r = math.log2((len(both) + short * prior) / (max(words[w], len(both)) + short) / prior) / -math.log2(prior)
            assert min(abs(r - share), abs(r - remove)) > 1e-9
            if r >= share:
                for k in both:
                    out[k][w] = max(out[k].get(w, 0), 5 if r >= remove else 4)
    return out


def test_entities_in_few_texts_are_rated(spark):
    r = random.Random(5)
    letters = "abcdefghij"
    words = ["w" + letters[k // 100] + letters[k // 10 % 10] + letters[k % 10] for k in range(300)]
    texts = [" ".join(r.choices(words, k=12)) for _ in range(300)]
    texts += [" ".join([*r.choices(words, k=8), f"p{k // r.choice([1, 1, 2, 3, 5])}@x.example", *([f"q{k}@x.example"] * (k % 2)), "unique" + letters[k // 10] + letters[k % 10]]) for k in range(60)]
    texts += texts[-4:] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (0.8, 0.45):
        want = rated_by_brute_force(texts, share, 0.97, 3)
        assert any(want)
        for row in pii.sanitise(df, share=share).collect():
            spans = [x.split(":") for x in row.spans.split(",")] if row.spans else []
            got = {texts[row.doc_id][int(s):int(e)]: pii.KINDS.index(k) for k, s, e in spans if k in ("generalise", "remove")}
            assert got == want[row.doc_id]


def test_rating_beyond_ascii(spark):
    """Terms are the same on both sides whatever lower case does to them."""
    r = random.Random(6)
    words = ["İstanbul", "İzmirli", "Straße", "STRASSE", "ΣΟΦΟΣ", "σοφος", "Mannheim", "École", "kelvin", "\u212aelvin"]
    texts = [f"{words[k % 10]} and {words[k * 7 % 10]} wrote n{k // 3}@x.example about {r.choice(words)}" for k in range(60)]
    texts += [f"nothing about {r.choice(words[3:])} number {'abcdefghij'[k % 10] * 3}" for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rated_by_brute_force(texts, 0.3, 0.97, 3)
    flagged = set()
    for row in pii.sanitise(df, share=0.3).collect():
        spans = [x.split(":") for x in row.spans.split(",")] if row.spans else []
        got = {texts[row.doc_id][int(s):int(e)].lower(): pii.KINDS.index(k) for k, s, e in spans if k in ("generalise", "remove")}
        assert got == want[row.doc_id]
        flagged |= set(got)
    assert {"İstanbul".lower(), "İzmirli".lower()} <= flagged


def test_terms_are_the_same_in_both_languages(spark):
    texts = ["İstanbul ŞİŞLİ ẞ STRASSE straße", "ΑΣ ΣΟΦΟΣ ΌΔΟΣ σοφός", "ǅungla Ǆ ﬁn Ωhm \u212aelvin", "a1bcd2efg abc_def don't ÀÉÎ 日本語", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", pii.terms_of(F.col("text")).alias("t")).collect():
        assert set(row.t) == {t for t, _, _ in pii.masked_terms(row.text, [])}


def test_long_ids_beside_nulls(spark):
    ids = [2**53 + 1, None, 2**62 + 3, -(2**60) - 7]
    df = spark.createDataFrame([(i, f"mail a{k}@b.cd" if k % 2 else "none") for k, i in enumerate(ids)] + [(2**53 + 3, "mail x@y.zz")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in pii.sanitise(df).collect()} == {*ids, 2**53 + 3}
