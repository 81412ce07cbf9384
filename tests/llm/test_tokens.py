import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import mixing, packing, token_counts, tokens

WHOLE = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))
TEXTS = ["", None, "Hello, world's 12 words!", "ΑΣ Σ ς", "İstanbul ǅ", "a\x1cb \x1f", "<|endoftext|> x <|startoftext|>", "日本語 test ½ ﬁ", "x" * 5000, "we'll '''s don't''ve", "\u00a0\u2003a\u3000b\x85c", "e\u0301 \u0301", ":\U0003d000 \U0001f600! \u0378x"]


def exact(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(tokens.encoder().ids(text), "<u4").tolist() == exact(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizer_on_any_text(text):
    assert np.frombuffer(tokens.encoder().ids(text), "<u4").tolist() == exact(text)


def test_ids_equal_the_tokenizer_on_every_character_of_the_basic_plane():
    chars = [chr(i) for i in range(1, 0x10000) if not (0xD800 <= i < 0xE000 or 0x1C <= i < 0x20)]
    for k in range(0, len(chars), 1000):
        for form in ("a{}b", "{}.", "{}'s", "1{}"):
            text = " ".join(form.format(c) for c in chars[k : k + 1000])
            assert np.frombuffer(tokens.encoder().ids(text), "<u4").tolist() == exact(text), (form, k)


def test_chunks_that_recur_are_encoded_once(monkeypatch):
    """A full cache must not forget frequent chunks; it stays bounded, and what it holds stays right."""
    monkeypatch.setattr(tokens, "CACHE", 50)
    coder, calls = tokens.WordBPE(public_tokenizers.path(tokens.DEFAULT)), Counter()
    merge = coder.merge
    coder.merge = lambda raw: (calls.update([raw]), merge(raw))[1]
    words = ["".join(chr(97 + int(d)) for d in f"{k:04d}") for k in range(1000)]
    for k in range(0, 1000, 10):
        text = " ".join(["frequent", *words[k : k + 10], "frequent"])
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == exact(text)
        assert len(coder.cache) <= 50
    assert calls[b"frequent\xff"] == 1 and len(calls) == 1001
    assert len(coder.cache) + len(coder.cache.old) <= 100
    coder.ids("x" * 65)
    assert "x" * 65 not in coder.cache


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_tokens int")


def test_token_counts(spark):
    texts = [*TEXTS, *["word " * n for n in (1, 1, 3, 600, 600, 1100)]]
    n = [len(exact(t)) for t in texts]
    rows = {r.n_tokens: r for r in token_counts.token_counts(frame(spark, texts)).collect()}
    assert {k: r.docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert (r.docs_longer, r.tokens_longer, r.truncated_total) == (sum(x > k for x in n), sum(x for x in n if x > k), sum(min(x, k) for x in n))
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
    table = token_counts.token_counts(frame(spark, texts))
    got = {r.limit: (r.docs_longer, r.truncated_total) for r in token_counts.at_limits(table, [0, 2, 500, 10**6]).collect()}
    assert got == {x: (sum(y > x for y in n), sum(min(y, x) for y in n)) for x in (0, 2, 500, 10**6)}
    assert token_counts.at_quantile(table, 0.5).collect()[0][0] == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.token_counts(frame(spark, []).limit(0)).count() == 0


def test_pieces_and_packing(spark):
    texts = [*TEXTS, "word " * 10_000, *["w " * (i * 37 % 900) for i in range(60)]]
    df = frame(spark, texts).union(frame(spark, texts).limit(2))
    rows = packing.pack_documents(df).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*exact(t), 1]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        copies = 2 if i < 2 else 1
        assert len(mine) == copies * -(-len(ids) // 4096)
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    valid(rows, 4096)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-total // 4096)


def valid(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("group", [3, 5, 8, 200])
def test_packing_in_groups(spark, group):
    """With small groups what is left goes through several levels; their sequences must not meet."""
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    rows = packing.pack(df, 100, group=group).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == sorted(enumerate(sizes))
    valid(rows, 100)
    if group == 200:
        assert len({x.sequence_id for x in rows}) <= 1.05 * sum(sizes) / 100 + 5
    assert packing.pack(df.limit(0), 100).count() == 0


def test_equal_rows_are_spread_over_groups(spark):
    df = spark.createDataFrame([(None, 3)] * 2000, "doc_id long, length long").repartition(4)
    rows = packing.pack(df, 10, group=100).collect()
    valid(rows, 10)
    assert len({x.sequence_id for x in rows}) == 667


def best_fit_decreasing(sizes, capacity):
    free = []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= n
        else:
            free.append(capacity - n)
    return len(free)


def optimum(sizes, capacity):
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                bins[b] += sizes[k]
                place(k + 1, bins)
                bins[b] -= sizes[k]
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def squares(bins, sizes):
    return int((np.bincount(bins, sizes) ** 2).sum())


def test_local_search_against_the_optimum():
    r = random.Random(7)
    over = made = 0
    for _ in range(150):
        sizes = np.array([r.randint(3, 40) for _ in range(9)])
        start = packing.next_fit(sizes, 60)
        end, steps = packing.local_search(sizes, start, 60)
        fill = np.bincount(end, sizes)
        assert fill.max() <= 60 and sizes.sum() == fill.sum()
        assert squares(end, sizes) >= squares(start, sizes) + steps and (steps > 0 or (end == start).all())
        used, best = int((fill > 0).sum()), optimum(sorted(sizes.tolist(), reverse=True), 60)
        assert best <= used <= max(start) + 1
        over += used - best
        made += max(start) + 1 - used
    assert over <= 8 and made > 60


def test_search_leaves_no_improving_step():
    """Every move and exchange of one or two, tried one by one, on what the search ends with."""
    r = random.Random(8)
    for _ in range(40):
        sizes = np.array([r.randint(20, 59) for _ in range(14)])
        end, _ = packing.local_search(sizes, packing.next_fit(sizes, 60), 60)
        fill = np.bincount(end, sizes)
        if (fill > 0).sum() == -(-sizes.sum() // 60):
            continue
        for a in range(14):
            for out in [(a,), *((a, b) for b in range(a) if end[a] == end[b])]:
                total = int(sizes[list(out)].sum())
                for dst in set(end.tolist()) - {end[a]}:
                    for back in ([0] if len(out) == 1 else []) + [int(sizes[j]) for j in range(14) if end[j] == dst and sizes[j] < total]:
                        d = total - back
                        assert fill[dst] + d > 60 or fill[dst] == 60 or fill[dst] + d <= fill[end[a]]


def test_search_packs_as_well_as_best_fit(spark, sf_dir):
    cut = packing.pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = np.sort(np.array([r.length for r in cut.select("length").collect()]))[::-1]
    r = np.random.default_rng(3)
    for sizes in (n, r.integers(300, 2500, 1500), np.minimum(4096, np.exp(r.normal(6, 1.2, 1500)).astype(int) + 1)):
        sizes = np.sort(sizes)[::-1]
        start = packing.next_fit(sizes, 4096)
        end, steps = packing.local_search(sizes, start, 4096)
        used = int((np.bincount(end, sizes) > 0).sum())
        assert steps > 0 and used < max(start) + 1 and used <= best_fit_decreasing(sizes.tolist(), 4096)


def test_search_counts_gains_beyond_32_bits():
    r = np.random.default_rng(5)
    for unit in (1, 1000):  # the same steps in any unit
        sizes = np.sort(r.integers(10, 101, 200))[::-1] if unit == 1 else sizes * 1000
        end, steps = packing.local_search(sizes, packing.next_fit(sizes, 100 * unit), 100 * unit)
        assert np.bincount(end, sizes).max() <= 100 * unit
        first = (end, steps) if unit == 1 else first
    assert steps == first[1] > 0 and (end == first[0]).all()


def test_search_empties_a_bin_that_best_fit_leaves():
    sizes, bins = np.array([6, 6, 4, 4, 4, 3, 3]), np.array([0, 1, 0, 2, 2, 1, 3])  # 30 of capacity 10 in four bins
    end, steps = packing.local_search(sizes, bins, 10)
    assert steps > 0 and len(np.unique(end)) == 3 and np.bincount(end, sizes).max() <= 10


def test_exponent():
    t = np.array([800.0, 100.0, 100.0, 0.0])
    a = mixing.find_exponent(t, 1000, 0.9, None)
    w = mixing.tempered(t / t.sum(), a)
    assert mixing.entropy(w) == pytest.approx(0.9 * np.log(3), abs=1e-6) and w[3] == 0
    b = mixing.find_exponent(t, 1000, 1.0, 2.0)
    assert (mixing.tempered(t / t.sum(), b)[:3] * 1000 / t[:3]).max() == pytest.approx(2.0, abs=1e-6)
    assert mixing.find_exponent(t, 1000, None, None) == 1.0 and mixing.find_exponent(t, 5000, 0.9, 2.0) == 1.0
    assert mixing.find_exponent(np.zeros(2), 0, 0.9, 2.0) == 1.0


def test_mix(spark):
    texts = ["a b c " * (i % 7 + 1) for i in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t, "big" if i < 240 else None if i < 270 else "small") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    n = [len(exact(t)) for t in texts]
    rows = mixing.mix(df).collect()
    total, by = sum(n), {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.n_tokens == n[r.doc_id]
    for source, mine in by.items():
        ids = [i for i in range(302) if (("big" if i < 240 else None if i < 270 else "small") == source)]
        own = sum(n[i] for i in ids)
        goal = int(total * mine[0].weight)
        got = sum(r.n_tokens for r in mine)
        assert goal - max(n) <= got <= goal
        times = Counter(r.doc_id for r in mine)
        assert set(times.values()) <= {goal // own, goal // own + 1} and (goal < own or set(times) == set(ids))
        for e in {r.epoch for r in mine}:
            order = [r.doc_id for r in sorted((r for r in mine if r.epoch == e), key=lambda r: (r.block, r.position))]
            assert len(order) == len(set(order)) and order != sorted(order)
    assert len({tuple(sorted((r.source or "", r.doc_id, r.epoch) for r in mixing.mix(df.repartition(k)).collect())) for k in (1, 7)}) == 1
    assert mixing.mix(df.limit(0)).count() == 0
    copies = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert copies == Counter(r.doc_id for r in rows)


def test_large_ids_beside_nulls(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b c"), (None, "d"), (-big, None), (big + 2, "x " * 9000)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert sorted({r.doc_id for r in rows}, key=repr) == sorted([big, None, -big, big + 2], key=repr)
    assert [r.piece for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == big + 2] == list(range(sum(r.doc_id == big + 2 for r in rows))) and len(rows) > 4
