from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, token_budget
from tidemark.llm.vocab_tokens import VocabTokenizer

PIECES = ["the", "to", "token", "##ken", "##s", "a", "##b", "中", "."]


def test_tokenizer():
    t = VocabTokenizer(PIECES)
    assert t.tokens("The TOKENS, a b. 中文x") == ["the", "token", "##s", "[UNK]", "a", "[UNK]", ".", "中", "[UNK]", "[UNK]"]
    assert t.count(None) == 0 and t.count("") == 0 and t.count(" \n\t") == 0
    assert t.tokens("tokenb") == ["token", "##b"] and t.tokens("zzz") == ["[UNK]"]
    assert t.count("token " * 1000) == 1000


def test_budget_is_near_the_exact_count(spark, data, vocab):
    sft = spark.read.parquet(f"{data}/../sf0.01/sft_rows.parquet")
    keys = ["source_dataset", "language", "domain"]
    both = token_budget.token_budget(sft, vocab).join(token_budget.exact_tokens(sft, vocab).withColumnRenamed("tokens", "true").drop("rows"), keys).collect()
    assert len(both) > 50
    assert sum(r.tokens for r in both) == pytest.approx(sum(r.true for r in both), rel=0.01)
    assert sum(abs(r.tokens - r.true) for r in both) < 0.03 * sum(r.true for r in both)
    assert sum(r.tokens_low <= r.true <= r.tokens_high for r in both) >= 0.93 * len(both)


def test_bounds_hold_out_of_sample(spark, data, vocab, monkeypatch):
    monkeypatch.setattr(token_budget, "FIT_ROWS", 1000)
    monkeypatch.setattr(token_budget, "HOLDOUT_ROWS", 500)
    sft = spark.read.parquet(f"{data}/../sf0.1/sft_rows.parquet")
    keys = ["source_dataset", "language", "domain"]
    both = token_budget.token_budget(sft, vocab).join(token_budget.exact_tokens(sft, vocab).withColumnRenamed("tokens", "true").drop("rows"), keys).collect()
    assert len(both) > 100 and sum(r.tokens_low <= r.true <= r.tokens_high for r in both) >= 0.93 * len(both)
    assert sum(r.tokens for r in both) == pytest.approx(sum(r.true for r in both), rel=0.01)
    wide = sorted((r.tokens_high - r.tokens_low) / r.tokens for r in both if r.tokens > 2000)
    assert wide[len(wide) // 2] < 0.25


def test_budget_of_odd_rows(spark, vocab):
    rows = [(1, None, None, None, None), (2, [], "", " Math ", "und"), (3, [("hello world", "user"), (None, "user")], "s", "math", "EN"), (3, [("hello world", "user")], "s", "MATH", "en-GB")]
    df = spark.createDataFrame(rows, "row_id long, messages array<struct<content:string,role:string>>, source_dataset string, domain string, language string").withColumn("tokens", F.lit(1)).withColumn("text", F.lit("x"))
    got = {(r.source_dataset, r.language, r.domain): (r.rows, r.tokens) for r in token_budget.exact_tokens(df, vocab).collect()}
    assert got[("s", "en", "math")][0] == 2 and got[("(none)", "und", "(none)")] == (1, 0) and got[("(none)", "und", "math")] == (1, 0)
    assert {(r.source_dataset, r.language, r.domain) for r in token_budget.token_budget(df, vocab).collect()} == set(got)
    assert token_budget.token_budget(df.limit(0), vocab).count() == 0


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, metadata string, bin string, copies int")


def test_shares_are_reached(spark, vocab):
    rows = [(i, "big", "the report " * (5 + i % 7), '{"quality": %.3f}' % (0.1 + (i % 9) / 10)) for i in range(400)]
    rows += [(1000 + i, "small", "the report " * 6, None) for i in range(12)] + [(2000, None, "the", None), (2001, "", "the", "cut {"), (2002, "big", None, None), (2003, "big", "", "{}")]
    targets = spark.createDataFrame([("big", 0.5, 1, None), ("small", 0.06, 4, None), ("gone", 0.1, 2, "n"), ("small2", 0.34, None, None)], "source string, target_share double, max_repeats int, note string")
    d = docs(spark, rows)
    got = {r.source: r for r in mixing.mix_shares(d, targets, vocab).collect()}
    total = sum(r.tokens for r in mixing.source_sizes(d, vocab).collect())
    assert got["big"].tokens_reached == pytest.approx(0.5 * total, rel=0.02) and got["big"].most_copies == 1
    assert got["small"].tokens_reached == pytest.approx(0.06 * total, rel=0.06) or got["small"].most_copies == 4
    assert got["gone"].tokens_reached == 0 and got["small2"].tokens_reached == 0
    a = {(r.doc_id, r.copies) for r in mixing.mix_documents(d, targets, vocab).collect()}
    b = {(r.doc_id, r.copies) for r in mixing.mix_documents(d.repartition(5), targets, vocab).collect()}
    assert a == b and not {2000, 2001, 2002, 2003} & {i for i, _ in a}


def test_better_documents_are_likelier(spark, vocab):
    rows = [(i, "s", "the report " * 6, '{"quality": 0.9}' if i % 2 else '{"quality": 0.1}') for i in range(2000)]
    targets = spark.createDataFrame([("s", 0.3, 1, None)], "source string, target_share double, max_repeats int, note string")
    ids = [r.doc_id for r in mixing.mix_documents(docs(spark, rows), targets, vocab).collect()]
    assert len(ids) == pytest.approx(600, abs=3) and sum(i % 2 for i in ids) > 0.8 * len(ids)


def test_empty(spark, vocab):
    targets = spark.createDataFrame([("s", 1.0, 1, None)], "source string, target_share double, max_repeats int, note string")
    assert mixing.mix_documents(docs(spark, []), targets, vocab).count() == 0
    assert mixing.mix_shares(docs(spark, []), targets, vocab).first().tokens_reached == 0
