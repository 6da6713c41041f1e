from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import shared_spans
from tidemark.llm.anchors import anchors


def filler(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcdefghijklmnop qrstuv\n") for _ in range(n))


def brute(docs, size):
    grams: dict[str, set[int]] = {}
    for i, t in docs:
        for k in range(len(t or "") - size + 1):
            grams.setdefault(t[k : k + size], set()).add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def corpus():
    shared = filler("s", 700)
    docs = [
        (1, filler(1, 900) + "#" + shared[:320] + "#" + filler(2, 300)),
        (2, filler(3, 50) + "%" + shared[:320]),
        (3, filler(4, 50) + shared[:319] + "#" + filler(5, 200)),
        (4, shared),
        (5, shared),
        (6, filler(6, 400) + "!" + shared[100:600] + "!" + filler(7, 100) + "!" + shared[:330]),
        (7, None),
        (8, ""),
        (9, "x" * 2000),
        (10, filler(8, 30) + "x" * 400),
        (11, "é😀" * 200),
        (12, "zz" + "é😀" * 200),
        (13, filler(9, 319)),
    ]
    return docs


def test_pairs_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, i, "n") for i, t in docs], "doc_id long, text string, id long, anchor string").repartition(3)
    got = {(r.doc_a, r.doc_b) for r in shared_spans.shared_pairs(df).collect()}
    assert got == brute(docs, 320)
    assert (4, 5) in got and (1, 3) not in got and (9, 10) in got and (11, 12) in got


def test_shares(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in shared_spans.shared_share(df).collect()}
    assert len(got) == len(docs)
    assert got[4].shared_chars == 700 and got[5].class_id == 4 and got[4].shared_share == 1.0
    assert got[1].shared_chars == 320 and got[2].shared_chars == 320 and got[3].shared_chars == 0
    assert got[6].shared_chars == 500 + 330
    assert got[7].shared_share is None and got[8].shared_share is None and got[13].shared_chars == 0


def brute_share(docs, size):
    grams: dict[str, set[int]] = {}
    for i, t in docs:
        for k in range(len(t) - size + 1):
            grams.setdefault(t[k : k + size], set()).add(i)
    return {i: len({c for k in range(len(t) - size + 1) if len(grams[t[k : k + size]]) > 1 for c in range(k, k + size)}) for i, t in docs}


def test_share_counts_every_place_on_both_sides(spark):
    p, q = filler("p", 400), filler("q", 330)
    twice = p + filler("x", 100) + p
    docs = [(1, twice), (2, p), (3, q + "#" + filler("y", 90) + "%" + q + "~"), (4, "!" + q), (5, "^" + q + "=" + filler("z", 80) + "+" + q), (6, "ab" * 900), (7, "z" + "ab" * 300)]
    for shown in (docs, [(10 - i, t) for i, t in docs]):
        got = {r.doc_id: r.shared_chars for r in shared_spans.shared_share(spark.createDataFrame(shown, "doc_id long, text string")).collect()}
        assert got == brute_share(shown, 320)
    assert brute_share(docs, 320)[1] == 800


def test_hot_stretch_loses_no_pair(spark):
    hot = filler("hot", 330)
    docs = [(i, filler(i, 60) + hot + filler(-i, 40)) for i in range(1, 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    n = len(docs)
    assert shared_spans.shared_pairs(df).count() == n * (n - 1) // 2


def test_many_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(shared_spans, "QUERY_CHARS", 4000)
    monkeypatch.setattr(shared_spans, "ROUTED", 10)
    hot = filler("hot", 330)
    docs = corpus() + [(i, filler(i, 60) + hot + filler(-i, 40)) for i in range(20, 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r.doc_a, r.doc_b) for r in shared_spans.shared_links(df).collect()]
    assert len(got) == len(set(got))
    assert {(r.doc_a, r.doc_b) for r in shared_spans.shared_pairs(df).collect()} == brute(docs, 320)


def test_greedy_factors():
    import numpy as np

    from tidemark.llm.anchors import code_points
    from tidemark.llm.relative_lz import ReferenceBlock

    a, b, c = filler("a", 500), filler("b", 300), filler("c", 200)
    block = ReferenceBlock(np.array([1, 2, 3, 3]), [a[:400], a + b, "", c + b[:90]], 100)
    codes = code_points("!" + a + "#" + c + "?" + b[:95])
    got = block.factors(codes, 9)
    assert [(p, n) for p, _, n in got] == [(1, 500), (502, 200)]  # the longest source is taken; 95 characters are literal
    assert got[0][1] == 400 and block.texts_with(codes, got[0], 9).tolist() == [1, 2]
    assert block.factors(codes, 3)[0][2] == 500 and [n for _, _, n in block.factors(codes, 3)] == [500]
    assert [(p, n) for p, _, n in block.factors(code_points(a), 2)] == [(0, 400)]
    assert ReferenceBlock(np.zeros(0), [], 100).factors(codes, 1) == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans.shared_pairs(df).count() == 0 and shared_spans.shared_share(df).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=40, max_size=160), st.text("ab", max_size=60), st.text("ab", max_size=60), st.integers(0, 100))
def test_every_shared_stretch_has_a_common_anchor(body, left, right, cut):
    width, run = 12, 9
    part = body[cut % 10 : cut % 10 + width + run - 1]
    a, b = body, left + part + right
    owner, pos, h = anchors([a, b], width, run)
    assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())


def test_long_text_in_pieces(monkeypatch):
    import tidemark.llm.anchors as m

    text = filler("long", 5000)
    whole = anchors([text], 50, 30)
    monkeypatch.setattr(m, "PIECE", 700)
    cut = anchors([text], 50, 30)
    assert set(whole[1].tolist()) == set(cut[1].tolist())


def test_merging(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 12, 13), (2, 1, 2), (2, 1, 2)], "k long, start int, stop int")
    got = sorted(tuple(r) for r in shared_spans.merge_spans(df, ["k"]).select("k", "start", "stop").collect())
    assert got == [(1, 0, 9), (1, 12, 13), (2, 1, 2)]
    assert shared_spans.merge_spans(df.where(F.lit(False)), ["k"]).count() == 0
