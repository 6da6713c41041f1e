from __future__ import annotations

import numpy as np

from tidemark.llm import language
from tidemark.llm.crf import ChainCRF, forward_backward, skip_chain_marginals

EN = "The report describes how the tokenizer and the loss curve change together."
DE = "Der Bericht beschreibt, wie die Verlustkurve und die Quelle zusammenhängen."


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    n, T, L = 3, 4, 3
    e, t, s = r.normal(size=(n, T, L)), r.normal(size=(2, L, L)), r.normal(size=L)
    lengths, kind = np.array([4, 2, 1]), r.integers(0, 2, (n, T))
    m, pair, logz = forward_backward(e, lengths, t, kind, s)
    import itertools

    total = np.zeros((2, L, L))
    for i in range(n):
        w, marg, pairs = 0.0, np.zeros((lengths[i], L)), np.zeros((2, L, L))
        for y in itertools.product(range(L), repeat=int(lengths[i])):
            p = np.exp(s[y[0]] + sum(e[i, k, y[k]] for k in range(lengths[i])) + sum(t[kind[i, k], y[k - 1], y[k]] for k in range(1, lengths[i])))
            w += p
            for k in range(lengths[i]):
                marg[k, y[k]] += p
                if k:
                    pairs[kind[i, k], y[k - 1], y[k]] += p
        total += pairs / w
        assert np.allclose(m[i, : lengths[i]], marg / w) and np.isclose(logz[i], np.log(w))
    assert np.allclose(pair, total)


def test_skip_edges_pull_labels_together():
    weak, strong = np.array([[0.0, 0.1], [0.0, 0.0]]), np.array([[0.0, 3.0], [0.0, 0.0]])
    chain = np.concatenate([strong, weak])
    args = (np.zeros((1, 2, 2)), np.zeros(2), np.array([[1.5, -1.5], [-1.5, 1.5]]))
    tied = skip_chain_marginals([chain], [[(0, 2)]], *args)[0]
    free = skip_chain_marginals([chain], [[]], *args)[0]
    assert tied[2, 1] > free[2, 1] + 0.2 and np.allclose(tied.sum(1), 1)


def test_held_out_words(samples):
    rows = [(r.lang, r.text) for r in samples.orderBy("sample_id").collect()]
    model = language.train([x for i, x in enumerate(rows) if i // 6 % 3])
    right = total = 0
    held = [x for i, x in enumerate(rows) if i // 6 % 3 == 0]
    for (lang, _), f in zip(held, language.label([t for _, t in held], model)):
        total += len(f["y"])
        right += sum(model.labels[k] == lang for k in f["y"])
    assert right / total > 0.97


def tables(spark, sft, dpo, rl):
    msg = "array<struct<content:string,role:string>>"
    return (
        spark.createDataFrame(sft, f"row_id long, messages {msg}, language string, lang string"),
        spark.createDataFrame(dpo, "row_id long, prompt string, language string, stage string"),
        spark.createDataFrame(rl, "row_id long, prompt string, language string, text string"),
    )


def test_cases(spark, samples):
    sft = [
        (1, [(EN, "user"), (DE, "assistant")], "en", "x"),
        (2, [(EN, "user"), (DE, "user")], "en-GB", "x"),
        (3, None, None, "x"),
        (4, [(None, "user")], "en", "x"),
        (1, [(EN, "user"), (DE, "assistant")], "en", "x"),
    ]
    dpo = [(1, EN, " German ", "s"), (2, EN, None, "s"), (3, None, None, "s"), (4, "", "und", "s"), (5, "```\nx = 1\n```", "", "s"), (6, EN, "ENG", "s"), (7, EN + ' It cites "Verlustkurve" twice.', "en", "s")]
    rl = [(1, "user: " + (DE + " ") * 3000, "de", "t"), (2, "user: " + EN, "fr-CA", "t"), (3, EN + " “" + DE + "”", "English", "t")]
    got = sorted(tuple(r) for r in language.label_cases(*tables(spark, sft, dpo, rl), samples).collect())
    assert got == [("dpo", 1, "en"), ("dpo", 2, "en"), ("rlvr", 2, "en"), ("rlvr", 3, "de"), ("rlvr", 3, "en"), ("sft", 2, "de"), ("sft", 2, "en")]
    assert language.label_cases(*tables(spark, [], [], []), samples).count() == 0


def test_segments(spark, samples):
    df = spark.createDataFrame([(1, EN + "\n" + DE), (2, None), (3, "")], "k long, text string")
    got = {r.k: r for r in language.label_languages(df, ["k"], "text", samples).collect()}
    assert [s.lang for s in got[1].segments] == ["en", "de"] and min(s.confidence for s in got[1].segments) > 0.8
    assert (EN + "\n" + DE)[got[1].segments[0].start : got[1].segments[0].stop] == EN[:-1]
    assert got[2].lang is None and got[2].segments == [] and got[3].confidence == 0.0


def test_very_long_sequence():
    model = ChainCRF(["a", "b"], lambda w: [w])
    assert model.marginals([["x"] * 20_000])[0].shape == (20_000, 2)
