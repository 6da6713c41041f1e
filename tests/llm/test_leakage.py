from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leakage
from tidemark.llm.fm_index import FMIndex, suffix_array

Q = "Which claim about the birch paddle of Ostmoor follows once Figant counted seven crates"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.lists(st.integers(0, 5), min_size=3, max_size=3))
def test_search_and_locate(seq, phrase):
    ix = FMIndex(np.array(seq))
    low, high = ix.search(np.array([phrase]))
    got = sorted(ix.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(seq) - 2) if seq[i : i + 3] == phrase]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_suffix_array(seq):
    assert suffix_array(np.array(seq)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


def rows(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, i, "p") for i, t in docs], "doc_id long, text string, item_id long, part string"),
        spark.createDataFrame(items, "item_id long, benchmark string, split string, question string, answer string"),
    )


def test_leaks(spark):
    docs = [
        (1, "x. " + Q.upper().replace(" ", " -- ") + "!"),
        (2, " ".join(Q.split()[2:12])),
        (3, " ".join(Q.split()[2:11])),  # nine words
        (4, " ".join(Q.split()[2:7]) + " other " + " ".join(Q.split()[7:12])),
        (5, None),
        (6, ""),
        (7, Q + " " + Q),
        (1, "repeated id without a leak"),
    ]
    items = [(10, "b", "test", Q, None), (11, "b", "test", "too short", "Also " + Q), (12, "c", None, None, "")]
    df, it = rows(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_pairs(df, it).collect()}
    assert got == {(d, i) for d in (1, 2, 7) for i in (10, 11)}
    spans = {(r.doc_id, r.start, r.stop) for r in leakage.removal_spans(df, it).collect()}
    assert (2, 0, len(docs[1][1])) in spans and (7, 0, len(docs[6][1])) in spans or (7, 0, len(Q)) in spans
    by = {r.benchmark: r for r in leakage.leaks_by_benchmark(df, it).collect()}
    assert (by["b"].items, by["b"].leaked_items, by["b"].documents) == (2, 2, 3) and by["c"].leaked_items == 0


def test_blocks_of_items_and_shards(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 20)
    monkeypatch.setattr(leakage, "SHARD", 50)
    df, it = rows(spark, [(i, Q if i % 3 == 0 else "nothing here") for i in range(12)], [(k, "b", "t", Q, "a") for k in range(5)])
    assert leakage.leaked_pairs(df, it).count() == 4 * 5


def test_places_keep_the_text_as_it_is():
    text = "Straße İstanbul ok"
    assert [text[a:b] for a, b in leakage._places(text)][0] == "Straße"


def test_empty(spark):
    df, it = rows(spark, [], [])
    assert leakage.leaked_pairs(df, it).count() == 0 and leakage.leaks_by_benchmark(df, it).count() == 0
