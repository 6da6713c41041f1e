from __future__ import annotations

from tidemark.llm import pairs, truncation
from tidemark.llm.minhash import BANDS, Sketcher, jaccard

MSG = "array<struct<content:string,function_calls:string,role:string>>"
PAIR = "array<struct<content:string,role:string>>"
Q = "What is the difference between the label run and the sampling route?"
A = "Our estimate for the label run moved from 20 to 30 once the sampling route was corrected."
DE = "Der Bericht beschreibt, wie die Verlustkurve und die Quelle zusammenhängen. Viele vergessen, dass die Anfrage älter ist als das Etikett."


def tables(spark, sft, dpo=()):
    s = spark.createDataFrame([(i, m, src, "x", 1) for i, m, src in sft], f"row_id long, messages {MSG}, source_dataset string, stage string, turn int")
    d = spark.createDataFrame([(i, c, r, "src") for i, c, r in dpo], f"row_id long, chosen {PAIR}, rejected {PAIR}, dataset_source string")
    return s, d


def turn(text, role="assistant", calls=None):
    return (text, calls, role)


def test_open_and_closed_forms():
    assert truncation.open_structure("Look:\n```\nx = 1") == "code"
    assert truncation.open_structure("see (run 5") == "bracket"
    assert truncation.open_structure("Go to https://docs.quarrynet.exam") == "link"
    assert truncation.open_structure("| a | b |\n| c | d") == "table"
    for t in ("Done.", "```\nx\n```", "text\n#### 42", "text\n= 12", "\\boxed{5}", "| a | b |", "https://docs.site.example/p/12", "{\"a\": 1}", "fine 🙂", "好的。", "<think>so</think>\n\n", "see [12]"):
        assert truncation.open_structure(t) is None and truncation.closed_form(t), t
    for t in ("and then the", "moved from 20 to"):
        assert truncation.open_structure(t) is None and not truncation.closed_form(t)


def test_cut_turns(spark, data):
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{data}/../sf0.01/sft_rows.parquet")
    few = base.select((F.col("row_id") + 1000).alias("row_id"), F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["function_calls"].alias("function_calls"), m["role"].alias("role"))).alias("messages"), "source_dataset", F.lit("x").alias("stage"), F.lit(1).alias("turn"))
    sft = [
        (1, [turn(Q, "user"), turn(A), turn(A[:-20])], "s"),
        (2, [turn(Q, "user"), turn(None), turn("")], None),
        (3, [turn(Q[:-1], "user"), turn(Q[:-1])], ""),
        (4, [turn("Run:\n```\nx = (1", "user")], "s"),
        (5, None, "s"),
        (1, [turn(Q, "user"), turn(A), turn(A[:-20])], "s"),
    ]
    s, d = tables(spark, sft, [(1, [(Q, "user"), (A[:40], "assistant")], None)])
    got = sorted((r.stage, r.row_id, r.side, r.turn) for r in truncation.truncated_turns(s.unionByName(few), d).where("row_id < 1000").collect())
    assert got == [("dpo", 1, "chosen", 1), ("sft", 1, "messages", 2), ("sft", 1, "messages", 2), ("sft", 4, "messages", 0)]


def test_near_copies_are_found_and_aligned(spark):
    full = " ".join(f"word{i} of{i % 7} the text{i * 3}" for i in range(120)) + "."
    cut = full[: int(len(full) * 0.93)]
    sk = Sketcher()
    assert jaccard(sk.shingles(full), sk.shingles(cut)) > 0.8
    which, span, _, keys = sk.head_bands([full, cut, "something else entirely different from it all here and on it goes for some more words than sixteen", "too short"])
    of = [set(keys[which == i].ravel().tolist()) for i in range(4)]
    assert of[0] & of[1] and not of[0] & of[2] and of[2] and not of[3] and keys.shape[1] == BANDS
    assert span[which == 0].tolist() == [16, 32, 64, 128, 256, 0]
    top, _, _, few = sk.head_bands([cut], top_only=True)
    assert len(top) == 2 and {x for x in few.ravel().tolist()} <= of[1]
    a, b = cut.lower().split(), full.lower().split()
    assert truncation.align_end(a, b) == len(a) - 1
    ts, _ = tables(spark, [(1, [turn(full)], "s"), (2, [turn(cut)], "s")])
    every = truncation.turns(ts, "sft", "messages", "source_dataset")
    got = truncation.copy_verdicts(every.where("row_id = 2"), every).collect()
    assert [r.cut for r in got] == [1]


def test_end_is_found_behind_a_paragraph_more(spark):
    words = [f"{'abcdefgh'[i % 8]}{i}" for i in range(1000)]
    more, less = words[:500] + [f"new{i}" for i in range(60)] + words[500:], words[:500] + words[560:]
    a = words[:950]
    assert truncation.align_end(a, more) == 1009 and truncation.align_end(a, less) == 889
    assert truncation.align_end(a, [f"z{i}" for i in range(1000)]) == -1
    closing = [f"c{i}" for i in range(60)]  # the same closing words twice
    assert truncation.align_end(words[:300] + closing, words[:100] + closing + words[100:300] + closing + words[300:400]) == 419
    ts, _ = tables(spark, [(1, [turn(" ".join(a))], "s"), (2, [turn(" ".join(more) + ".")], "s")])
    every = truncation.turns(ts, "sft", "messages", "source_dataset")
    assert [r.cut for r in truncation.copy_verdicts(every.where("row_id = 1"), every).collect()] == [1]


def test_longer_texts_of_a_band_displace_no_near_copy(spark):
    import random

    r = random.Random(4)
    full = [f"{r.choice('abcdefgh')}{i}" for i in range(150)]
    cut = " ".join(full[:140])
    others = []
    for i in range(150):  # much longer texts that are less like the cut one than a near copy
        x = full[:140]
        for k in r.sample(range(140), 7):
            x[k] = f"replacement{i}of{k}" * 3
        others.append(" ".join(x) + ".")
    sk = Sketcher()
    assert jaccard(sk.shingles(cut), sk.shingles(" ".join(full))) > 0.8
    assert all(jaccard(sk.shingles(cut), sk.shingles(x)) < 0.8 for x in others)
    ts, _ = tables(spark, [(1, [turn(cut)], "s"), (2, [turn(" ".join(full) + ".")], "s"), *((3 + i, [turn(x)], "s") for i, x in enumerate(others))])
    every = truncation.turns(ts, "sft", "messages", "source_dataset")
    assert [r.cut for r in truncation.copy_verdicts(every.where("row_id = 1"), every).collect()] == [1]


def test_blocks_of_a_band_lose_no_pair(spark):
    same = " ".join(f"w{i}" for i in range(100))
    ts, _ = tables(spark, [(i, [turn(f"{same} x{i}")], "s") for i in range(1, 2 * truncation.BLOCK)] + [(1000, [turn(f"{same} and so on it goes.")], "s")])
    every = truncation.turns(ts, "sft", "messages", "source_dataset")
    got = truncation.copy_verdicts(every.where("row_id < 1000"), every)
    assert got.count() == 2 * truncation.BLOCK - 1


def test_copies_cut_anywhere_are_found_by_alignment(spark):
    import random

    r = random.Random(12)
    rows, want, i = [], set(), 0
    for share in (0.3, 0.5, 0.7, 0.9):
        for _ in range(40):
            i += 1
            w = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))]
            full = " ".join(x + ("." if k % 11 == 10 else "") for k, x in enumerate(w)) + "."
            copy = full.split(" ")
            for k in r.sample(range(len(copy)), max(1, len(copy) // 60)):  # a near copy
                copy[k] = "changed"
            text = " ".join(copy)
            end = int(len(text) * share)
            while not (text[end - 1].isalnum() and text[end].isalnum()):  # inside a word
                end += 1
            rows += [(i, [turn(full)], "s"), (1000 + i, [turn(text[:end])], "s")]
            want.add(1000 + i)
    s, d = tables(spark, rows)
    found = {x.row_id for x in truncation.truncated_turns(s, d).where("evidence = 'alignment'").collect()}
    assert len(found & want) >= 0.9 * len(want) and not found - want


def test_sample_is_cut_by_hash(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    n = truncation.hash_sample(df, 1000).count()
    assert 850 < n < 1150 and truncation.hash_sample(df, 50_000).count() == 20_000
    same = spark.range(20_000).selectExpr("5L AS row_id")
    assert truncation.hash_sample(same, 1000).count() <= 2000
    assert truncation.hash_sample(df.where("row_id < 0"), 10).count() == 0


def test_set_of_sought_bands(spark):
    keys = [5, -7, 2**62, -(2**63), 63, 64]
    bits = truncation.sought_bands(spark.createDataFrame([(k,) for k in keys], "band long")).value
    import numpy as np

    at = np.array(keys, np.int64).view(np.uint64) % np.uint64(truncation.SOUGHT_BITS)
    assert all((int(bits[int(p) >> 6]) >> (int(p) & 63)) & 1 for p in at) and sum(bin(int(x)).count("1") for x in bits) == len(set(at.tolist()))


def test_field_limits(spark):
    rows = [("sft", "s", 500, 0.0)] * 8 + [("sft", "s", 480 + i, 0.0) for i in range(3)] + [("sft", None, 90, 0.0)] * 4 + [("sft", "s", 300, 0.9)] * 9
    got = {tuple(r) for r in truncation.field_limits(spark.createDataFrame(rows, "stage string, source string, chars int, score double")).collect()}
    assert got == {("sft", "s", 500), ("sft", None, 90)}


def test_refusals():
    for t in (
        "I'm sorry, but I can't help with that request. Feel free to ask me something else.",
        "Providing this would be against the policy I work under. I hope you understand.",
        "Es tut mir leid, aber dabei kann ich nicht helfen.",
        "Je suis désolé, mais je ne peux pas vous aider avec cette demande.",
        "Lo siento, pero no puedo ayudar con esa petición.",
        "Sinto muito, mas não posso ajudar com esse pedido.",
        "抱歉，这个问题我不能回答。",
    ):
        assert pairs.refuses(t), t
    for t in (
        'Typical wordings are "I\'m sorry" or "I can\'t assist", followed by a reason.',
        "I'm sorry, but I can't join the workshop on that day. Thank you for thinking of me, and I hope it goes well.",
        "Dear team, we must decline your offer this quarter. We are grateful for the time you spent on it.",
        "I cannot stress enough that the report describes the label run as a cousin of the judge, with 4 small differences.",
        A,
        "",
    ):
        assert not pairs.refuses(t), t


def test_copies():
    assert pairs.copies(Q, Q) and pairs.copies(Q, "> " + Q.upper()) and pairs.copies(Q, Q[:-1] + " ...")
    assert not pairs.copies(Q, A) and not pairs.copies(Q, Q + " " + A) and not pairs.copies("", "x") and not pairs.copies(Q, "")


def test_defects(spark, samples):
    sft = [
        (1, [turn(Q, "user"), turn(A)], "s"),
        (2, [turn(Q, "user"), turn("<think>x</think> ...")], "s"),
        (3, [turn(Q, "user"), turn(None), turn(Q.upper())], None),
        (4, [turn(Q, "user"), turn(DE, "Model")], "s"),
        (5, [turn("Please translate this into German: " + A, "user"), turn(DE)], "s"),
        (6, [turn("", "assistant")], "s"),
        (7, [turn(Q, "user"), turn("", calls="[{}]")], "s"),
        (8, [turn(Q, "user"), turn("I can't help with that.")], "s"),
        (9, [turn(Q, "user"), turn("see the code\n```\nx = (")], "s"),
        (10, [turn(None, "user"), turn(A)], "s"),
        (11, None, "s"),
    ]
    got = sorted((r.row_id, r.turn, r.defect) for r in pairs.defective_answers(*tables(spark, sft), samples).collect())
    assert got == [(2, 1, "empty"), (3, 1, "empty"), (3, 2, "copy"), (4, 1, "language"), (8, 1, "refusal"), (9, 1, "truncated")]
    assert pairs.defective_answers(*tables(spark, []), samples).count() == 0
