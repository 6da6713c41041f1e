from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tidemark.llm import crf, pii, pii_training

SCHEMA = "row_id long, messages array<struct<content:string,role:string>>, turn int, kind string"


def tables(spark, rows):
    sft = spark.createDataFrame([(i, [(t, "user") for t in turns] if turns is not None else None, 0, "k") for i, turns in rows], SCHEMA)
    chat = sft.limit(0).withColumnRenamed("messages", "conversation")
    return sft, chat


ROWS = [
    (1, ["Call me on +44 20 7946 0337 after lunch.", None, ""]),
    (2, ["Please send it to vela.morrin@post.example.net by Friday.", "My name is Tovrin Halmark."]),
    (3, ["My social security number is 666-82-6362. I live at 184 Fenmill Lane."]),
    (4, ["The package is pinned to probe-kit@4.41.58. Order 55-28-48 was closed. The log shows 10.0.35.58 on port 7."]),
    (5, ["Already masked: [EMAIL_11], [PHONE_94] and <NAME_26>. (ISBN 978-0-306-9054-7) (2023-09-50)"]),
    (6, None),
    (7, []),
    (8, ["Plain words, nothing else. " * 2000]),
    (1, ["Call me on +44 20 7946 0337 after lunch.", None, ""]),
]


def test_cases(spark, samples):
    got = sorted(tuple(r) for r in pii.pii_cases(*tables(spark, ROWS), samples).distinct().collect())
    assert got == [("sft", 1, 0, "phone"), ("sft", 2, 0, "email"), ("sft", 2, 1, "name"), ("sft", 3, 0, "id_number"), ("sft", 3, 0, "street")]


def test_masking_leaves_the_rest(spark, samples):
    found = pii.find_pii(pii.turn_texts(*tables(spark, ROWS)), ["stage", "row_id"], "turns", samples, with_text=True)
    got = {r.row_id: r.masked for r in found.collect()}
    assert got[1][0] == "Call me on [PHONE] after lunch." and got[1][1] is None and got[1][2] == ""
    assert got[2][0] == "Please send it to [EMAIL] by Friday."
    assert got[4][0] == ROWS[3][1][0] and got[5][0] == ROWS[4][1][0] and got[8][0] == ROWS[7][1][0]


def test_empty(spark, samples):
    assert pii.pii_cases(*tables(spark, []), samples).count() == 0


@pytest.fixture(scope="module")
def model(samples):
    return pii.PiiModel([r.text for r in samples.collect()])


def test_accuracy_with_cue_words_not_seen_in_training(samples, model):
    texts = [r.text for r in samples.collect()]
    hit = want = found = 0
    docs = pii_training.documents(texts, 500, seed=99, unseen=True)
    records = [["".join(t for t, _ in d)] for d in docs]
    for d, out in zip(docs, model.label(records)):
        spans, at = [], 0
        for t, k in d:
            if k != "O":
                spans.append((k, at, at + len(t)))
            at += len(t)
        want += len(spans)
        found += len(out)
        hit += sum(any(k == kk and a < e and s < b for _, kk, a, b, _ in out) for k, s, e in spans)
    assert hit / want > 0.9 and hit / found > 0.88


def test_training_holds_no_text_of_the_tables(spark, data, samples):
    """No composed statement of four or more words stands in the turns; no cue has more than three words."""
    for table in (pii_training.CUES["name"], *pii_training.CUES.values(), pii_training._ACTS, pii_training.OTHER, pii_training._THING):
        assert all(len(c.split()) <= 3 for cues in table.values() for c in cues)
    own = {r.text for r in samples.collect()}
    texts = []
    for name, col in (("sft_rows", "messages"), ("chat_rows", "conversation")):
        for r in spark.read.parquet(f"{data}/../sf0.1/{name}.parquet").selectExpr(f"{col}.content AS c").collect():
            texts += [" ".join(re.findall(r"\w+", t.lower())) for t in r.c or [] if t]
    whole = "\n".join(dict.fromkeys(texts))
    for d in pii_training.documents(sorted(own), 600, seed=11):
        for t, k in d:
            words = re.findall(r"\w+", t.lower())
            if k == "O" and t not in own and len(words) >= 4:
                assert " ".join(words) not in whole, t


def test_names_of_other_forms(model):
    texts = ["Here ana de la Orvanta asked, with Belko von Trastberg.", "my name is juhann kestrovar and so on", "您好，我叫王晓东。", "请联系李建国先生。", "no zorblat quixley here", "王国的历史很长。"]
    got = [[(k, t[a:b]) for _, k, a, b, _ in out] for t, out in zip(texts, model.label([[t] for t in texts]))]
    assert ("name", "Belko von Trastberg") in got[0]
    assert got[1] == [("name", "juhann kestrovar")] and got[2] == [("name", "王晓东")] and got[3] == [("name", "李建国")]
    assert got[4] == [] and got[5] == []


def test_repeats_are_tied():
    edges = pii.skip_edges(["Tovrin", "came", "and", "Tovrin", "left", "with", "Halmark-Brenn", "x", "Halmark"], {"came", "left"})
    assert (0, 3) in edges and (6, 8) in edges


def test_every_word_of_every_turn_is_scored(model, monkeypatch):
    seen = []
    emissions = model.crf.emissions
    monkeypatch.setattr(model.crf, "emissions", lambda seqs: seen.extend(seqs) or emissions(seqs))
    turns = ["Plain words, nothing else. " * 30, None, "", "word " * 40 + "a.b@c.example " + "word " * 40, "这里没有任何东西。"]
    model.label([turns])
    assert [[w.partition("\x01")[0] for w in s] for s in seen] == [pii.tokens(t)[0] for t in turns if t]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Sender: Tovrin\tHalmark", "name", "Tovrin\tHalmark"),
        ("name | Tovrin\tHalmark |", "name", "Tovrin\tHalmark"),
        ("ID number | AB  12 34 56  C |", "id_number", "AB  12 34 56  C"),
        ("Write to vela.morrin (At) post.example.net", "email", "vela.morrin (At) post.example.net"),
    ],
)
def test_values_without_the_usual_blanks(model, text, kind, value):
    for turns in ([text], ["Plain words. " * 40, text, "Nothing else."]):
        (found,) = model.label([turns])
        assert [(k, turns[t][a:b]) for t, k, a, b, _ in found] == [(kind, value)]


def test_chinese_beside_a_number_is_no_street(model):
    assert not model._plausible("street", ["验", "6", "e4"], "") and model._plausible("street", ["中", "山", "路", "12", "号"], "")
    assert model.label([["在实验3714a中，旅行计划经过132步之后才重新建立。在实验6e4c6中，来源列经过218步之后才重新建立。"]]) == [[]]


def test_words_and_spans_of_odd_texts():
    r = random.Random(5)
    bits = ["foo", "Bar", " ", "  ", "@", "[at]", " (At) ", "[dot]", ".", "-", "_", "+", "12", "5551234", "(020)", "\n", "https://", "x@y.org", "王晓", "路12号", "'", "é", "[NAME_1]", "ext 5", "ſ", "İ", "ab1234567"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        want = [(c, i) for m in pii._TOKEN.finditer(text) for c, i in ([(m[0], m.start())] if not pii._WORDS_HAN.search(m[0]) else zip(m[0], range(m.start(), m.end())))]
        words, spans = pii.tokens(text)
        assert list(zip(words, [a for a, _ in spans])) == want and pii.words_of(text) == words and pii.spans_of(text, words) == spans


def test_chains_of_any_length_are_exact():
    """Blocks of a long chain, and chains stepped together, give the marginals of plain forward-backward."""
    r = np.random.default_rng(3)
    trans, start, agree = r.normal(size=(1, 6, 6)), r.normal(size=6), np.zeros((6, 6))
    chains = [r.normal(size=(n, 6)) * 3 for n in (1, 7, 300, crf.LONG - 1, crf.LONG, crf.LONG + crf.BLOCK + 3)]
    for e, got in zip(chains, crf.skip_chain_marginals(chains, [[(0, 0)] if len(e) == 7 else [] for e in chains], trans, start, agree)):
        want, _, _ = crf.forward_backward(e[None], np.array([len(e)]), trans, np.zeros((1, len(e)), np.int8), start)
        assert np.allclose(got, want[0], atol=1e-9)
