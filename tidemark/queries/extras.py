"""Queries of sources, streams, phrases, rewards and the reference-style relational checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import fields, phrases, rewards
from tidemark.plans import catalog
from tidemark.session import ensure_checkpoint_dir, table
from tidemark.sources import parquet
from tidemark.streaming import totals

Query = Callable[[SparkSession, str], DataFrame]

RULES = rewards.RewardRules(
    tags={"math": rewards.EXACT, "code": rewards.TESTS, "ifeval": rewards.CONSTRAINTS, "puzzle": rewards.EXACT, "general": rewards.JUDGE},
    parts={"proof": rewards.EXACT},
)


def _kinds(rl: DataFrame) -> DataFrame:
    return rl.select("row_id", RULES.kind("rl_rows", F.get("dataset", 0), F.col("dataset_source")).alias("kind"))


def _letter_votes(chat: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("conversation.language").alias("lang"), F.col("conversation.content").alias("content"))
    turns = chat.select("row_id", F.explode(zipped).alias("m")).where("m.lang is not null and m.content is not null")
    pieces = turns.select("row_id", F.col("m.lang").alias("code"), text.letters(F.col("m.content")).cast("long").alias("letters"), F.lit(1).alias("prob"))
    return rewards.letter_vote(pieces, ["row_id"], "code", "prob", "letters")


def _stream_grep(spark: SparkSession, d: str) -> DataFrame:
    s = totals.parquet_stream(spark, f"{d}/documents.parquet")
    return totals.drain(totals.stream_totals(s, fields.source_label(s, ["source"]), F.col("text"), text.literal_test("bus timetable")))


def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    s = totals.parquet_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = totals.drain(totals.stream_windows(s, "ts", "event_type", "1 day", "40 days"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """A result written to the catalog and found again."""
    import uuid

    root = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    catalog.save(docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.count(F.lit(1)).alias("rows")), root, "corpus", "pretrain", "sources", "all")
    return catalog.find(spark, root, "corpus", "pretrain", "sources").select("source", "rows", "target", "stage")


def queries() -> dict[str, Query]:
    t = table
    return {
        "scan_cost": lambda s, d: parquet.scan_cost(parquet.footers(s, f"{d}/sft_rows.parquet"), fields.text_plan(t(s, d, "sft_rows").schema).leaves),
        "leaf_bytes": lambda s, d: parquet.footers(s, f"{d}/rl_rows.parquet").groupBy("leaf").agg(F.sum("compressed_bytes").alias("compressed_bytes")),
        "row_page": lambda s, d: parquet.row_page(t(s, d, "documents"), "doc_id", 500, 100).select("doc_id", "n_chars"),
        "numbered_rows": lambda s, d: parquet.numbered(t(s, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("row_number").cast("long").alias("row_number")),
        "reward_kinds": lambda s, d: _kinds(t(s, d, "rl_rows")),
        "reward_composition": lambda s, d: rewards.composition(_kinds(t(s, d, "rl_rows"))),
        "letter_vote": lambda s, d: _letter_votes(t(s, d, "chat_rows")),
        "distinctive_phrases": lambda s, d: phrases.distinctive_phrases(t(s, d, "documents"), "doc_id", "text"),
        "pair_word_diff": lambda s, d: phrases.diff_summary(
            t(s, d, "dpo_rows").select("row_id", F.element_at(F.filter("chosen.content", lambda c: c.isNotNull()), -1).alias("a"), F.element_at(F.filter("rejected.content", lambda c: c.isNotNull()), -1).alias("b")), "row_id", "a", "b"
        ),
        "rendered_pairs": lambda s, d: phrases.render_pairs(t(s, d, "dpo_rows"), "row_id"),
        "stream_grep": _stream_grep,
        "stream_windows": _stream_windows,
        "saved_result": _saved,
    }


def oracle_sql() -> dict[str, str]:
    kind = "CASE WHEN starts_with(dataset[1], 'math') OR starts_with(dataset[1], 'puzzle') THEN 'exact answer match' WHEN starts_with(dataset[1], 'code') THEN 'unit tests' WHEN starts_with(dataset[1], 'ifeval') THEN 'constraint checker' WHEN starts_with(dataset[1], 'general') THEN 'LLM judge' WHEN contains(lower(dataset_source), 'proof') THEN 'exact answer match' ELSE 'unknown' END"
    source = "coalesce(nullif(source, ''), '(no source value)')"
    return {
        "row_page": "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 500 AND doc_id < 600",
        "numbered_rows": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM documents",
        "reward_kinds": f"SELECT row_id, {kind} AS kind FROM rl_rows",
        "reward_composition": f"""SELECT CASE kind WHEN 'LLM judge' THEN 'rlaif' WHEN 'unknown' THEN 'unknown' ELSE 'rlvr' END AS family, kind, count(*) AS rows,
CASE WHEN (SELECT count(*) FROM (SELECT {kind} AS k FROM rl_rows) u WHERE k = 'unknown') = 0 THEN round(count(*) * 1.0 / sum(count(*)) OVER (), 6) END AS share FROM (SELECT {kind} AS kind FROM rl_rows) x GROUP BY 1, 2""",
        "letter_vote": r"""SELECT row_id, CASE WHEN mass >= 12 AND w * 1.0 / mass > 0.5 THEN code ELSE 'undetermined' END AS lang, CASE WHEN mass >= 12 THEN round(w * 1.0 / mass, 6) ELSE 0.0 END AS confidence FROM (
SELECT row_id, code, w, sum(w) OVER (PARTITION BY row_id) AS mass, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, code) AS n FROM (
SELECT row_id, m.language AS code, sum(length(regexp_replace(m.content, '[^\p{L}\p{M}]', '', 'g'))) AS w FROM (SELECT row_id, unnest(conversation) AS m FROM chat_rows) x WHERE m.language IS NOT NULL AND m.content IS NOT NULL GROUP BY 1, 2) y) z WHERE n = 1""",
        "stream_grep": f"SELECT {source} AS source, count(*) AS rows, count(*) FILTER (WHERE contains(lower(text), 'bus timetable')) AS matched FROM documents GROUP BY 1",
        "stream_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2",
        "saved_result": f"SELECT {source} AS source, count(*) AS rows, 'corpus' AS target, 'pretrain' AS stage FROM documents GROUP BY 1",
    }
