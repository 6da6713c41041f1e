from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, contamination, matching, stages

RUN = "stage string, rows long, matched long, produced long, readable long, partial boolean, sides array<string>, available array<string>, unsearched array<string>"


def verdicts(spark, runs, registry=(("a", 0, "x"), ("b", 1, "y"), ("c", 2, None), ("d", 3, "z"))):
    r = spark.createDataFrame(list(registry), "stage string, place int, dataset string")
    return {x.stage: x for x in stages.stage_verdicts(r, spark.createDataFrame(runs, RUN)).collect()}


def test_five_verdicts(spark):
    p = ["prompt"]
    got = verdicts(spark, [("a", 100, 5, 2, 5, False, p, p, []), ("b", 100, 0, 0, 0, False, p, ["prompt", "rollout"], ["note"])])
    assert {k: v.status for k, v in got.items()} == {"a": "hits", "b": "inconclusive", "c": "unreachable", "d": "unsearched"}
    assert got["b"].gaps == "not read: rollout; not searched: note" and got["a"].rank == 1 and got["a"].basis == "produced"
    got = verdicts(spark, [("a", 100, 0, 0, 0, False, p, p, None), ("b", 0, 0, 0, 0, True, None, None, None)])
    assert got["a"].status == "zero" and got["b"].gaps == "only part of the table was there; the sides there are were not recorded"


def test_ranks_and_blocks(spark):
    p = ["prompt"]
    got = verdicts(spark, [("a", 100, 50, 0, 0, False, p, p, []), ("b", 1000, 30, 0, 30, True, p, p, []), ("d", 1000, 28, 0, 28, False, p, p, [])])
    assert got["a"].blocked and got["a"].rank is None and got["b"].rank == 1 and got["d"].rank == 2
    assert got["d"].contender and got["b"].understated and got["b"].basis == "readable"
    assert len(verdicts(spark, [], ())) == 0


def test_budget(spark):
    registry = spark.createDataFrame([("s", "post", "x"), ("t", "post", "y"), ("u", "pre", "z"), ("v", "pre", "w")], "stage string, family string, dataset string")
    sizes = spark.createDataFrame([("s", 1000, "x", "r", False), ("t", 10, "y", "old", False), ("u", 100, "z", "r", None)], "stage string, total long, size_dataset string, size_revision string, straddled boolean")
    ex = [("s", 400, 500, True, "rows", "x", "r"), ("s", 1200, 1300, False, "rows", "x", "r"), ("s", None, 10, True, "rows", "x", "r"), ("t", 5, 5, True, "rows", "y", "new"), ("u", 100, 100, True, "shards", "z", "r"), ("u", 300, 300, False, "shards", "z", "r")]
    b = stages.stage_budget(registry, sizes, spark.createDataFrame(ex, "stage string, fit_chars long, all_chars long, matched boolean, route string, ex_dataset string, ex_revision string"))
    got = {r.stage: r for r in b.collect()}
    assert got["s"].size_tokens == 1000 * 800 / 4 and got["s"].rate == 0.25 and got["s"].tokens == 50_000 and got["s"].tokens_low < 50_000 < got["s"].tokens_high <= 200_000
    assert got["t"].unsized == "row count of another revision" and got["t"].tokens is None and got["v"].unsized == "no examples"
    assert got["u"].rate == 0.5  # of documents
    t = {r.family: r for r in stages.budget_totals(b).collect()}
    assert t["all"].unsized == "t, v" and t["all"].tokens == got["s"].tokens + got["u"].tokens and t["post"].stages == 2


def test_steps_in_order():
    assert stages.topological({"pairs": ["labels", "draw"], "labels": ["context"], "context": ["draw"]}) == ["draw", "context", "labels", "pairs"]
    with pytest.raises(ValueError):
        stages.topological({"a": ["b"], "b": ["a"]})


def test_cells_and_fixtures(spark):
    df = spark.createDataFrame([(1, "t", ["a", None, "b"], ("x" * 50, [1, 2, 3]), None), (2, None, None, None, 2.5)], "id long, s string, l array<string>, n struct<k:string,v:array<int>>, d double")
    got = df.select(*[cells.cell_text(df, c).alias(c) for c in ("s", "l", "n", "d")]).collect()
    assert got[0].s == "t" and got[0].l == "a\nb" and got[0].n.startswith('{"k":"xxx') and got[0].d == "" and got[1].d == "2.5" and got[1].n == ""
    small = cells.fixture_rows(df, chars=3, items=2).collect()
    assert small[0].n.k == "xxx" and small[0].n.v == [1, 2] and small[0].l == ["a", None] and small[1].n is None and small[1].s is None


def test_numbers_as_words(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(cells.percent(F.lit(v))) for v in (None, 0.0, 0.25, 0.034, 0.0034, 0.00034, 0.0000034)] == ["—", "0%", "25%", "3.4%", "0.34%", "0.034%", "0.00034%"]
    assert one(cells.one_in(F.lit(0.0001))) == "1 in 10,000" and one(cells.one_in(F.lit(0.0))) == "" and one(cells.bytes_text(F.lit(2.5e9))) == "2.50 GB"
    assert one(cells.snapshot(F.lit('{"cc_dump": "CC-MAIN-2021-10", "q'))) == "CC-MAIN-2021-10" and one(cells.snapshot(F.lit('{"cc_segment": "crawl/CC-MAIN-2020-05/x"}'))) == "CC-MAIN-2020-05" and one(cells.snapshot(F.lit("{}"))) is None


def test_batches_and_replies(spark):
    asked = cells.batches(spark.range(45).selectExpr("id AS k", "id AS row_number"), "k")
    assert asked.groupBy("batch").count().count() == 3
    replies = spark.createDataFrame([(0, "ok", 'Here: [{"i": 0, "label": "yes"}, {"i": 1, "label": "maybe"}, {"i": 0, "label": "no"}, {"i": "x"}]'), (1, "refused", None)], "batch long, status string, reply string")
    got = {r.k: (r.label, r.dropped) for r in cells.read_replies(asked, replies, ["yes", "no"]).collect()}
    assert got[0] == ("no", None) and got[1] == (None, "invalid") and got[2] == (None, "unlabelled") and got[20] == (None, "refused") and got[44] == (None, "no reply")
    bad = cells.read_replies(asked, spark.createDataFrame([(0, "ok", "no list")], replies.schema), ["yes"]).where("batch = 0").select("dropped").distinct().collect()
    assert [r.dropped for r in bad] == ["unparsed"]


def test_crosstab_pairing_lengths(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b"), (4, None), (9, "a")], "k long, lab string")
    groups = spark.createDataFrame([(1, "g"), (1, "g"), (2, "h"), (3, "g"), (3, "h"), (4, "i"), (None, "g")], "k long, grp string")
    got = {(r.group, r.label): r.rows for r in matching.crosstab(labels, groups, "k", "lab", "grp", top=1).collect()}
    assert got == {("g", "a"): 1, ("2 smaller values", "a"): 1, ("2 smaller values", None): 1, (matching.UNDECIDABLE, "b"): 1, (matching.UNMATCHED, "b"): 1, (matching.UNMATCHED, "a"): 1}
    e = matching.pairing_evidence(labels, groups, "k").first()
    assert (e.matched, e.only_a, e.only_b, e.verdict) == (4, 1, 0, "refused") and matching.pairing_evidence(labels, labels, "k").first().verdict == "equal"
    assert matching.pairing_evidence(labels.limit(0), labels.limit(0), "k").first().verdict == "refused"
    shown = spark.createDataFrame([(1, "t"), (2, None), (3, "u")], "id long, text string")
    stored = spark.createDataFrame([("t", 5), ("t", 7), (None, 1)], "text string, chars int")
    assert sorted(tuple(r) for r in matching.lengths_by_text(shown, stored, "id", "text").collect()) == [(1, 7, True), (2, None, False), (3, None, False)]


def test_probes_on_the_sides_of_rows(spark):
    q = "Janet sells sixteen fresh duck eggs at the farmers market every single day for two dollars"
    items = spark.createDataFrame([(7, "b", q, "she makes eighteen dollars at the market on each of her days"), (8, "b", None, "")], "item_id long, benchmark string, question string, answer string")
    rows = spark.createDataFrame(
        [(1, [("user", f"Solve: {q}!"), ("assistant", "She makes eighteen dollars at the market on each of her days.")]), (2, [("assistant", q), (None, None)]), (3, None), (1, [("user", f"Solve: {q}!")])],
        "row_id long, messages array<struct<role:string,content:string>>",
    ).withColumn("item_id", F.lit(0)).withColumn("side", F.lit("x"))
    hit = contamination.side_hits(rows, "row_id", items)
    assert {(r.row, r.side, r.item_id, r.part) for r in hit.collect()} == {(1, "prompt", 7, "question"), (1, "response", 7, "answer"), (2, "response", 7, "question")}
    assert hit.count() == 3
    s = contamination.item_sets(hit, items).first()
    assert (s["items"], s.any_seen, s.question_read, s.question_produced, s.answer_produced, s.answer_scored, s.answer_rejected) == (2, 1, 1, 1, 1, 0, 0)
    assert {(r.side, r.part): (r.rows, r["items"]) for r in contamination.side_counts(hit).collect()} == {("prompt", "question"): (1, 1), ("response", "answer"): (1, 1), ("response", "question"): (1, 1)}


def test_escapes_are_boundaries_of_credentials(spark):
    import base64

    from tidemark.functions import text

    token = base64.urlsafe_b64encode(b"123456789012345678").decode().rstrip("=") + ".AbCdEf." + "z" * 30
    shown = [f"\\n{token}", f"\\u00e9{token} x", f"\\{token}", f"a{token}"]
    got = [r.r for r in spark.createDataFrame([(t,) for t in shown], "t string").select(text.redact(F.col("t")).alias("r")).collect()]
    m = text.CREDENTIAL_MARKER
    assert got == [f"\\n{m}", f"\\u00e9{m} x", shown[2], shown[3]]


def test_numbering_with_nulls_and_ties(spark):
    from tidemark.sources import parquet

    df = spark.createDataFrame([(i % 7 if i % 5 else None,) for i in range(50)], "k long").repartition(3)
    got = sorted(r.row_number for r in parquet.numbered(df, "k").collect())
    assert got == list(range(50)) and parquet.numbered(df.limit(0), "k").count() == 0


def test_ngrams_and_postings(spark):
    from collections import Counter

    from tidemark.operators import terms

    texts = ["the Short poem the short poem", "a  b\nthe short poem", None, "", "x y", "the short poem"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, gram int").repartition(3)
    seen, docs = Counter(), Counter()
    for t in texts:
        w = (t or "").lower().split()
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        seen.update(g)
        docs.update(set(g))
    got = {r.gram: (r.occurrences, r.documents) for r in terms.ngram_counts(df, "text").collect()}
    assert got == {g: (seen[g], docs[g]) for g in seen}
    assert [r.gram for r in terms.ngram_counts(df, "text", 3, 4).collect()] == ["the short poem"] and terms.ngram_counts(df.limit(0), "text").count() == 0
    p = terms.postings(spark.createDataFrame([(1, "abc"), (12, "xABC"), (13, "ab"), (14, None)], "k long, t string"), "k", "t", 10)
    assert sorted((r.gram, r.block, r.postings) for r in p.collect()) == [("abc", 0, [1]), ("abc", 1, [12]), ("xab", 1, [12])]
