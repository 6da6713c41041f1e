"""Queries over stored records, settled items, paired labels and estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import contamination, fields, records, rewards
from tidemark.queries.audit import _HITS, _PROBES, _RATERS, _raters, _src, _wilson
from tidemark.queries.extras import _kinds
from tidemark.session import table

_TURNS = "(SELECT row_id, CAST(i - 1 AS INTEGER) AS turn, messages[i].role AS role, substr(messages[i].content, 1, 200) AS text, CAST(length(messages[i].content) AS INTEGER) AS chars, CASE WHEN length(messages[i].content) > 200 THEN sha256(messages[i].content) END AS sha FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM sft_rows) x WHERE messages[i].content IS NOT NULL)"

#: the same turns kept to the operator's default of 4000 characters
_TURNS_4000 = _TURNS.replace("content, 1, 200)", "content, 1, 4000)").replace("> 200 THEN", "> 4000 THEN")


def _matching(docs: DataFrame) -> DataFrame:
    hit, n = F.contains(F.lower("text"), F.lit("bus timetable")), F.length("text")
    g = docs.where("length(text) > 0").groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("matched"), F.sum(F.when(hit, n).otherwise(0)).alias("mc"), F.sum(n).alias("c")
    )
    return records.matching_tokens(g, F.col("c") / 4, F.col("mc") / F.col("c"), F.col("matched"), F.col("rows"), ["source"])


def _density(docs: DataFrame) -> DataFrame:
    phrases = ["bus timetable", "short poem", "loss curve"]
    hits = sum(F.contains(F.lower("text"), F.lit(p)).cast("long") for p in phrases)
    g = docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(hits, F.lit(0))).alias("hits"))
    return g.select("source", "rows", "hits", F.round(F.col("hits") / F.col("rows") * 1e6, 6).alias("per_million"))


def _gaps(sft: DataFrame) -> DataFrame:
    g = sft.groupBy(fields.source_label(sft, ["source_dataset"]).alias("source")).agg(
        F.count_if(F.size("messages") < 1).alias("empty"), F.count_if(F.exists("messages.content", lambda c: c.isNull())).alias("nulls"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeats")
    )
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(r)) for c, r in (("empty", "rows without turns"), ("nulls", "turns without text"), ("repeats", "repeated rows"))]))
    return g.select("source", F.array_join(reasons, "; ").alias("gaps"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table

    def contaminated(s: SparkSession, d: str) -> DataFrame:
        items = t(s, d, "eval_items")
        probes = contamination.probes(items)
        return records.settle(items, probes, contamination.probe_hits(t(s, d, "documents"), ["doc_id"], "text", probes))

    def unpaired(s: SparkSession, d: str) -> DataFrame:
        chat = t(s, d, "chat_rows")
        flagged = F.exists(F.col("detoxify_moderation.toxicity"), lambda x: F.coalesce(x > 0.5, F.lit(False)))
        second = chat.where("detoxify_moderation is not null").select("row_id", F.when(flagged, "toxic").otherwise("clean").alias("label"))
        return records.paired(_raters(chat).where("b is not null").select("row_id", F.col("b").alias("label")), second, "row_id", "label")

    def family(s: SparkSession, d: str) -> DataFrame:
        docs = t(s, d, "documents")
        return docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.countDistinct("domain").alias("domains"), F.countDistinct("topic").alias("topics")).withColumn("mixed", F.col("domains") > 1)

    def shares(s: SparkSession, d: str) -> DataFrame:
        docs = t(s, d, "documents")
        g = docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("size"))
        return g.withColumn("share", F.round(F.col("size") / F.sum("size").over(Window.partitionBy()), 6))

    def languages(s: SparkSession, d: str) -> DataFrame:
        c = F.col("language")
        group = F.when(c.isNull() | (c == ""), "undetermined").when(F.lower(c).isin("en", "english", "eng", "en-gb"), "english").otherwise("other")
        g = t(s, d, "chat_rows").groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("rows"))
        return g.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6))

    def ambiguous(s: SparkSession, d: str) -> DataFrame:
        k = t(s, d, "rl_rows").where("prompt is not null").groupBy(F.left("prompt", F.lit(400)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return k.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("ambiguous"))

    def candidates(s: SparkSession, d: str) -> DataFrame:
        long = fields.field_rows(t(s, d, "rl_rows"), "row_id", ["dataset_source"])
        wanted = long.where(F.contains(F.lower("text"), F.lit("checkpoint"))).select("row").distinct()
        return long.join(wanted, "row", "left_semi").groupBy("side").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("row").alias("rows"))

    return {
        "context_turns": lambda s, d: records.context_turns(t(s, d, "sft_rows"), "row_id", "messages", 200),
        "search_censored": lambda s, d: records.censored_counts(records.context_turns(t(s, d, "sft_rows"), "row_id", "messages", 200), "row_id", text.literal_test("bus timetable")),
        "context_turns_4000": lambda s, d: records.context_turns(t(s, d, "sft_rows"), "row_id", "messages"),
        "search_censored_4000": lambda s, d: records.censored_counts(records.context_turns(t(s, d, "sft_rows"), "row_id", "messages"), "row_id", text.literal_test("bus timetable")),
        "item_status": contaminated,
        "labels_paired": unpaired,
        "matching_tokens": lambda s, d: _matching(t(s, d, "documents")),
        "phrase_density": lambda s, d: _density(t(s, d, "documents")),
        "coverage_gaps": lambda s, d: _gaps(t(s, d, "sft_rows")),
        "source_mixing": family,
        "composition_shares": shares,
        "language_groups": languages,
        "ambiguous_keys": ambiguous,
        "candidate_records": candidates,
        "verifier_labels": lambda s, d: _kinds(t(s, d, "rl_rows")).select("row_id", F.when(F.col("kind") == rewards.CONSTRAINTS, "instruction_following").alias("label")),
    }


def oracle_sql() -> dict[str, str]:
    lo, hi = _wilson("matched", "rows")
    scale = "coalesce((mc * 1.0 / c) / nullif(matched * 1.0 / rows, 0), 1.0)"
    one = "contains(lower(text), '{}')"
    hits = " + ".join(f"CAST({one.format(p)} AS BIGINT)" for p in ("bus timetable", "short poem", "loss curve"))
    field = """(SELECT row_id AS row, 'prompt' AS side, prompt AS text FROM rl_rows UNION ALL SELECT row_id, 'reference', unnest(ground_truth) FROM rl_rows UNION ALL SELECT row_id, 'rollout', unnest(outputs) FROM rl_rows
UNION ALL SELECT row_id, 'reference', reward_model.ground_truth FROM rl_rows UNION ALL SELECT row_id, 'prompt', unnest(source_prompt).content FROM rl_rows)"""
    return {
        "context_turns": f"SELECT * FROM {_TURNS} t",
        "search_censored": f"SELECT count(*) AS records, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit AND cut) AS censored, count(*) FILTER (WHERE NOT hit AND NOT cut) AS clear FROM (SELECT row_id, bool_or(contains(lower(text), 'bus timetable')) AS hit, bool_or(sha IS NOT NULL) AS cut FROM {_TURNS} t GROUP BY 1) x",
        "context_turns_4000": f"SELECT * FROM {_TURNS_4000} t",
        "search_censored_4000": f"SELECT count(*) AS records, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit AND cut) AS censored, count(*) FILTER (WHERE NOT hit AND NOT cut) AS clear FROM (SELECT row_id, bool_or(contains(lower(text), 'bus timetable')) AS hit, bool_or(sha IS NOT NULL) AS cut FROM {_TURNS_4000} t GROUP BY 1) x",
        "item_status": f"""SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM {_HITS} h) THEN 'present' WHEN parts > 0 AND parts = (SELECT count(*) FROM {_PROBES} p WHERE p.item_id = i.item_id) THEN 'absent' ELSE 'unresolved' END AS status
FROM (SELECT item_id, (question IS NOT NULL)::INT + (answer IS NOT NULL)::INT AS parts FROM eval_items) i""",
        "labels_paired": f"""SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS pairs, count(*) FILTER (WHERE x = y) AS agree, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS unpaired FROM
(SELECT row_id, b AS x FROM {_RATERS} r WHERE b IS NOT NULL) f FULL JOIN (SELECT row_id, CASE WHEN len(list_filter(detoxify_moderation, lambda m: m.toxicity > 0.5)) > 0 THEN 'toxic' ELSE 'clean' END AS y FROM chat_rows WHERE detoxify_moderation IS NOT NULL) g USING (row_id)""",
        "matching_tokens": f"""SELECT source, round(mc * 1.0 / c * (c / 4.0), 6) AS tokens, round(greatest(0, least(c / 4.0, ({lo}) * {scale} * (c / 4.0))), 6) AS tokens_low, round(greatest(0, least(c / 4.0, ({hi}) * {scale} * (c / 4.0))), 6) AS tokens_high FROM (
SELECT {_src("source")} AS source, count(*) AS rows, count(*) FILTER (WHERE {one.format("bus timetable")}) AS matched, sum(CASE WHEN {one.format("bus timetable")} THEN length(text) ELSE 0 END) AS mc, sum(length(text)) AS c FROM documents WHERE length(text) > 0 GROUP BY 1) t""",
        "phrase_density": f"SELECT source, rows, hits, round(hits * 1e6 / rows, 6) AS per_million FROM (SELECT {_src('source')} AS source, count(*) AS rows, CAST(sum(coalesce({hits}, 0)) AS BIGINT) AS hits FROM documents GROUP BY 1) t",
        "coverage_gaps": f"""SELECT source, array_to_string(list_filter([CASE WHEN e > 0 THEN 'rows without turns' END, CASE WHEN n > 0 THEN 'turns without text' END, CASE WHEN r > 0 THEN 'repeated rows' END], lambda x: x IS NOT NULL), '; ') AS gaps FROM (
SELECT {_src("source_dataset")} AS source, count(*) FILTER (WHERE len(messages) < 1) AS e, count(*) FILTER (WHERE len(list_filter(messages, lambda m: m.content IS NULL)) > 0) AS n, count(*) - count(DISTINCT id) AS r FROM sft_rows GROUP BY 1) t""",
        "source_mixing": f"SELECT source, domains, topics, domains > 1 AS mixed FROM (SELECT {_src('source')} AS source, count(DISTINCT domain) AS domains, count(DISTINCT topic) AS topics FROM documents GROUP BY 1) t",
        "composition_shares": f"SELECT source, size, round(size * 1.0 / sum(size) OVER (), 6) AS share FROM (SELECT {_src('source')} AS source, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS size FROM documents GROUP BY 1) t",
        "language_groups": "SELECT \"group\", rows, round(rows * 1.0 / sum(rows) OVER (), 6) AS share FROM (SELECT CASE WHEN language IS NULL OR language = '' THEN 'undetermined' WHEN lower(language) IN ('en', 'english', 'eng', 'en-gb') THEN 'english' ELSE 'other' END AS \"group\", count(*) AS rows FROM chat_rows GROUP BY 1) t",
        "ambiguous_keys": "SELECT count(*) AS keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS ambiguous FROM (SELECT substr(prompt, 1, 400) AS k, count(*) AS n FROM rl_rows WHERE prompt IS NOT NULL GROUP BY 1) t",
        "candidate_records": f"SELECT side, count(*) AS texts, count(DISTINCT row) AS rows FROM {field} f WHERE text IS NOT NULL AND row IN (SELECT row FROM {field} g WHERE contains(lower(text), 'checkpoint')) GROUP BY 1",
        "verifier_labels": "SELECT row_id, CASE WHEN starts_with(dataset[1], 'ifeval') THEN 'instruction_following' END AS label FROM rl_rows",
    }
