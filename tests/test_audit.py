from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import chains, contamination, fields, grep, phrases, preference, rewards, sampling

PAIR = "row_id long, prompt string, chosen array<struct<content:string,role:string>>, rejected array<struct<content:string,role:string>>, dataset_source string"


def pair(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def pairs3(spark):
    q = lambda p, a: [(p, "user"), (a, "assistant")]
    rows = [
        (0, "Interact as ChatGPT", q("Interact as ChatGPT", "As ChatGPT, sure"), q("Interact as ChatGPT", "no"), "web"),
        (1, "What is 2+2", q("What is 2+2", "As ChatGPT I would say 4"), q("What is 2+2", "5"), "math"),
        (2, "Say hi", q("Say hi", "hi"), q("Say hi", "HI"), "math"),
    ]
    return pair(spark, rows)


@pytest.mark.parametrize(
    ("test", "matched"),
    [
        (text.literal_test("ChatGPT"), 2),
        (text.literal_test("chatgpt"), 2),
        (text.literal_test("chatgpt", case_sensitive=True), 0),
        (text.regex_test("(As|Interact as) ChatGPT"), 2),
        (text.regex_test(r"^hi\z"), 1),
    ],
)
def test_grep_counts(spark, test, matched):
    got = grep.totals(grep.hits(pairs3(spark), "row_id", ["dataset_source"], test)).collect()
    assert sum(r.matched for r in got) == matched
    assert sum(r.rows for r in got) == 3


def test_grep_sides(spark):
    got = {r.source: r for r in grep.totals(grep.hits(pairs3(spark), "row_id", ["dataset_source"], text.literal_test("ChatGPT")), rollup=True).collect()}
    assert (got[None].prompt, got[None].chosen, got[None].rejected) == (1, 2, 0)
    assert (got["math"].prompt, got["math"].chosen, got["math"].matched) == (0, 1, 1)


def test_shared_history_is_prompt(spark):
    turns = lambda last: [("hi", "user"), ("shared ChatGPT reply", "assistant"), ("and then?", "user"), (last, "assistant")]
    df = pair(spark, [(0, None, turns("chosen answer"), turns("rejected answer"), None), (1, None, turns("same"), turns("same"), ""), (2, None, None, None, "x"), (3, "p", [], [], "x")])

    def sides(p):
        r = grep.hits(df, "row_id", ["dataset_source"], text.literal_test(p)).agg(*[F.count_if(s).alias(s) for s in ("prompt", "chosen", "rejected")]).first()
        return tuple(r)

    assert sides("ChatGPT") == (2, 0, 0)
    assert sides("chosen answer") == (0, 1, 0)
    assert sides("rejected answer") == (0, 0, 1)
    assert sides("same") == (0, 1, 1)  # identical completions stay candidates
    lengths = {r.row_id: r for r in preference.pair_lengths(df, ["row_id"]).collect()}
    assert (lengths[1].shared, lengths[1].shared_whole) == (3, 4)
    assert grep.totals(grep.hits(df, "row_id", ["dataset_source"], text.literal_test("x"))).where(F.col("source") == fields.NO_VALUE).first().rows == 2


def test_mapping_of_schemas(spark):
    sft = spark.createDataFrame([], "id string, messages array<struct<content:string,function_calls:string,functions:string,role:string>>, source_dataset string, domain string, notes string, tool_calls array<int>")
    plan = fields.text_plan(sft.schema)
    assert [(p[0], p[1]) for p in plan.pieces] == [("response", "messages"), ("prompt", "messages"), ("prompt", "messages.functions"), ("response", "messages.function_calls")]
    assert plan.unsearched == ["notes"]
    rl = spark.createDataFrame([], "prompt string, ground_truth array<string>, outputs array<string>, reward_model struct<ground_truth:string,style:string>, source_prompt array<struct<content:string,role:string>>, constraint string")
    assert fields.text_plan(rl.schema).sides() == ["prompt", "reference", "rollout"]
    assert fields.text_plan(rl.schema, ("prompt",)).leaves == [("prompt",), ("source_prompt", "content")]


def test_only_needed_leaves_are_read(spark, data):
    df = spark.read.parquet(f"{data}/chat_rows.parquet")
    hit = grep.totals(grep.hits(df, "row_id", ["model"], text.literal_test("x")))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "content" in read and "role" in read and "user-agent" not in read and "hashed_ip" not in read


def test_wilson_and_cluster_intervals(spark):
    def clustered(rows):
        df = spark.createDataFrame(rows, "c string, y int")
        g = df.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("k"))
        t = g.agg(F.sum("m").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("c")).first()
        ss = g.agg(F.sum(F.pow(F.col("k") - t.k / t.n * F.col("m"), 2)).alias("ss"))
        return ss.select(stats.cluster_effective_n(F.lit(t.c), F.lit(t.n), F.lit(t.k), F.col("ss")).alias("n")).first().n

    assert clustered([("a", 1)] * 5 + [("b", 0)] * 5) == pytest.approx(1.0)
    assert clustered([(str(i), int(i < 3)) for i in range(10)]) == pytest.approx(9.0)
    assert clustered([("a", 1), ("a", 0), ("b", 1), ("b", 0)]) == pytest.approx(4.0)
    lo, hi = spark.range(1).select(*stats.wilson(F.lit(0.5), F.lit(1.0))).first()
    assert (lo, hi) == (pytest.approx(0.05462, abs=1e-4), pytest.approx(0.94538, abs=1e-4))
    assert tuple(spark.range(1).select(*stats.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 0.0)


def test_union_bounds_and_kappa(spark):
    row = spark.range(1).select(*stats.union_bounds(F.lit(180), F.lit(0), [F.lit(100), F.lit(80)])).first()
    assert tuple(row) == (180, 180)
    k = spark.range(1).select(stats.kappa(F.lit(3), F.lit(4), F.lit(12)).alias("k"), stats.kappa(F.lit(0), F.lit(0), F.lit(0)).alias("z"), stats.kappa(F.lit(2), F.lit(2), F.lit(4)).alias("one")).first()
    assert k.k == pytest.approx(0.0) and k.z is None and k.one is None


def test_log_bins(spark):
    df = spark.createDataFrame([(1,), (10,), (5000,), (10**9,), (0,), (-3,)], "v long")
    got = [r.b for r in df.select(stats.half_decade(F.col("v")).alias("b")).collect()]
    assert got == [0, 0, 5, 10, None, None]


ITEMS = [
    (0, "b", "Janet sells duck eggs at the farmers market for two dollars each", "She has sixteen minus seven equals nine eggs to sell"),
    (1, "b", "A robe takes two bolts of blue fiber and half that white", None),
    (2, "b", "Absent words that nobody has ever put in any row here", "short"),
]


def test_probes_and_hits(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, benchmark string, question string, answer string")
    p = contamination.probes(items, size=5, least=3)
    docs = [
        (0, "Question: Janet sells duck eggs at the\n  farmers market for two dollars each!"),
        (1, "Unrelated: A ROBE TAKES TWO BOLTS OF BLUE FIBER AND HALF THAT WHITE"),
        (2, "(eggs at the farmers market, said"),
        (3, "xeggs at the farmers market"),
        (4, None),
        (5, ""),
    ]
    got = contamination.probe_hits(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], "text", p).collect()
    assert {(r.doc_id, r.item_id, r.part) for r in got} == {(0, 0, "question"), (1, 1, "question"), (2, 0, "question")}
    roll = contamination.item_rollup(spark.createDataFrame(got), items).first()
    assert (roll.items, roll.seen, roll.question_seen, roll.answer_seen) == (3, 2, 2, 0)


def test_text_functions(spark):
    row = spark.createDataFrame([("abc", "<think>why</think> so", "Hello, World! 12")], "a string, t string, s string")
    r = row.select(text.fnv32(F.col("a")).alias("f"), text.before_think(F.col("t")).alias("b"), text.after_think(F.col("t")).alias("c"), text.slug(F.col("s")).alias("s")).first()
    h = 2166136261
    for c in "abc":
        h = ((h ^ ord(c)) * 16777619) % 2**32
    assert (r.f, r.b, r.c, r.s) == (f"{h:08x}", "why", "so", "hello-world-12")
    long = "x" * 100 + "needle" + "y" * 400
    s = spark.createDataFrame([(long,), ("needle",), ("no",), (None,)], "t string").select(text.snippet(F.col("t"), "needle", 60).alias("s")).collect()
    assert s[0].s.startswith("…") and s[0].s.endswith("…") and "needle" in s[0].s and s[1].s == "needle" and s[2].s is None
    with pytest.raises(ValueError):
        text.regex_test(r"(a)\1")


def test_redaction(spark):
    import base64

    token = base64.urlsafe_b64encode(b"123456789012345678").decode().rstrip("=") + ".AbCdEf." + "z" * 30
    other = base64.urlsafe_b64encode(b"not-an-account-id!").decode().rstrip("=") + ".AbCdEf." + "z" * 30
    df = spark.createDataFrame([(f"key {token} end",), (f"key {other} end",), (None,)], "t string")
    got = [r.r for r in df.select(text.redact(F.col("t")).alias("r")).collect()]
    assert got == [f"key {text.CREDENTIAL_MARKER} end", f"key {other} end", None]


def test_phrases_and_differences():
    got = phrases.distinctive("As an AI language model developed by OpenAI, my knowledge cutoff is September 2021. ChatGPT helps people.")
    joined = " | ".join(got).lower()
    assert "openai" in joined and "2021" in joined and "chatgpt" in joined
    assert phrases.distinctive("The weather was nice and we went out for a walk.") == []
    assert phrases.distinctive("") == []
    ops = phrases.word_diff("a b c d e".split(), "a x c e f".split())
    assert sum(o[1] for o in ops if o[0] == "same") == 3
    assert sum(o[1] for o in ops) == 5 and sum(o[2] for o in ops) == 5
    assert phrases.shares([5, 100, 100], 65) == [5, 30, 30]
    out = phrases.render([("[A]", "x" * 500), ("[B]", "short"), ("[C]", " ")], 120)
    assert "[A]" in out and "[B]\nshort" in out and "[C]" not in out and len(out) <= 120


def test_word_diff_is_a_longest_common_subsequence():
    import random

    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        ops = phrases.word_diff(a, b)
        assert sum(o[1] for o in ops if o[0] == "same") == table[-1][-1]
        assert sum(o[1] for o in ops) == len(a) and sum(o[2] for o in ops) == len(b)


def test_clusters_and_picks(spark):
    df = spark.createDataFrame([("g", x) for x in (10, 11, 12, 40, 41)], "g string, row long")
    assert [r.cluster for r in sampling.row_clusters(df, "row", ["g"]).orderBy("row").collect()] == [0, 0, 0, 1, 1]
    d = spark.range(100).select((F.col("id") % 7).alias("shard"), F.col("id").alias("doc"))
    assert sampling.even_picks(d, ["shard", "doc"], 10).count() == 10
    assert sampling.page_sample(d, "doc", 3, 1).count() == 30
    a = {r.doc for r in sampling.hash_sample(d.repartition(7), "doc", 9, 2).collect()}
    assert a == {r.doc for r in sampling.hash_sample(d.coalesce(1), "doc", 9, 2).collect()}


def test_sampler_matches_its_posterior(spark):
    losses = chains.sgld(spark, dimensions=6, chains=4, draws=1500, step=0.02, nbeta=10.0, localization=2.0, seed=3)
    mean = losses.agg(F.avg("loss").alias("m")).first().m
    assert mean == pytest.approx(0.5 * 6 / 12.0, rel=0.2)


def test_screens_flag_a_trend(spark):
    rows = [("flat", c, d, float((d * 7919 + c * 31) % 101)) for c in range(4) for d in range(200)] + [("trend", c, d, float(d)) for c in range(4) for d in range(200)]
    got = {r.name: r for r in chains.screens(spark.createDataFrame(rows, "name string, chain long, draw long, loss double")).collect()}
    assert got["flat"].split_rhat < 1.05 and got["flat"].max_time_correlation < 0.5
    assert got["trend"].split_rhat > 1.5 and got["trend"].max_time_correlation == pytest.approx(1.0)


def test_reward_composition_needs_every_kind(spark):
    rows = spark.createDataFrame([(rewards.EXACT,), (rewards.JUDGE,), (rewards.UNKNOWN,)], "kind string")
    assert {r.share for r in rewards.composition(rows).collect()} == {None}
    assert {r.family for r in rewards.composition(rows).collect()} == {"rlvr", "rlaif", "unknown"}
    votes = spark.createDataFrame([(1, "en", 20, 1.0), (1, "zh", 20, 1.0), (2, "zh", 30, 0.9), (2, "en", 5, 0.9), (3, "en", 4, 1.0)], "k long, code string, n long, p double")
    got = {r.k: (r.lang, r.confidence) for r in rewards.letter_vote(votes, ["k"], "code", "p", "n").collect()}
    assert got[1][0] == "undetermined" and got[2] == ("zh", pytest.approx(27 / 35, abs=1e-6)) and got[3] == ("undetermined", 0.0)


def test_empty_tables(spark):
    df = pairs3(spark).limit(0)
    assert grep.totals(grep.hits(df, "row_id", ["dataset_source"], text.literal_test("x"))).count() == 0
    assert preference.model_rule(spark.createDataFrame([], "chosen_model string, rejected_model string")).first().rate is None
    items = spark.createDataFrame([], "item_id long, benchmark string, question string, answer string")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert contamination.probe_hits(docs, ["doc_id"], "text", contamination.probes(items)).count() == 0


def test_records(spark):
    from tidemark.operators import records

    df = spark.createDataFrame([(1, [("x" * 30 + "needle", "user"), (None, "user")]), (2, [("needle here", "user")]), (3, [("short", None)]), (4, None)], "row_id long, ms array<struct<content:string,role:string>>")
    t = records.context_turns(df, "row_id", "ms", 20)
    assert sorted((r.row_id, r.chars, r.sha is not None, len(r.text)) for r in t.collect()) == [(1, 36, True, 20), (2, 11, False, 11), (3, 5, False, 5)]
    c = records.censored_counts(t, "row_id", text.literal_test("needle")).first()
    assert (c.records, c.matched, c.censored, c.clear) == (3, 1, 1, 1)
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k long, label string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (9, "x")], "k long, label string")
    p = records.paired(a, b, "k", "label").first()
    assert (p.pairs, p.agree, p.unpaired) == (2, 1, 2)
    left = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, None)], "k long, revision string")
    right = spark.createDataFrame([(1, "r1", 5), (2, "r2", 6)], "k long, revision string, v int")
    assert {r.k: r.status for r in records.guarded_join(left, right, ["k"]).collect()} == {1: "matched", 2: "stale", 3: "missing"}
    items = spark.createDataFrame(ITEMS, "item_id long, benchmark string, question string, answer string")
    probes = contamination.probes(items, 5, 3)
    hits = spark.createDataFrame([(7, 0, "question")], "doc_id long, item_id long, part string")
    assert {r.item_id: r.status for r in records.settle(items, probes, hits).collect()} == {0: "present", 1: "absent", 2: "unresolved"}


def test_production_limits(spark, data):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    q = entry.queries()
    sft = spark.read.parquet(f"{data}/sft_rows.parquet")
    whole = F.exists("messages.content", lambda c: F.coalesce(F.contains(F.lower(F.left(c, F.lit(4000))), F.lit("bus timetable")), F.lit(False)))
    got = q["search_censored_4000"](spark, data).first()
    assert got.matched == sft.where(whole).count() > q["search_censored"](spark, data).first().matched
    assert q["context_turns_4000"](spark, data).where("length(text) < least(chars, 4000)").count() == 0
    dpo = spark.read.parquet(f"{data}/dpo_rows.parquet").select("row_id", F.concat("chosen.content", "rejected.content").alias("b"))
    kept = {r.row_id: r.example for r in q["rendered_pairs"](spark, data).collect()}
    short = [(r.row_id, r.b) for r in dpo.collect() if r.b and 1200 < sum(len(b or "") for b in r.b) < 6000]
    assert short and all(b in kept[i] for i, bodies in short for b in bodies if b and b.strip())
