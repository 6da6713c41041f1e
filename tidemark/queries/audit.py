"""Queries of the audit operators over the test tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import chains, contamination, fields, grep, preference, sampling, terms
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _Q[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------------------------------------------------- SQL parts

_EMITS = "lower(coalesce(m.role, '')) IN ('assistant', 'model')"


def _src(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '(no source value)')"


def _wilson(k: str, n: str) -> tuple[str, str]:
    z = 1.96
    p, den = f"({k} * 1.0 / {n})", f"(1 + {z * z} / {n})"
    center = f"(({p} + {z * z} / (2.0 * {n})) / {den})"
    half = f"({z} * sqrt(greatest(0, {p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))) / {den})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {center} - {half}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {center} + {half}) ELSE 0.0 END"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _totals_sql(inner: str, sides: list[str], group: str = "GROUP BY source") -> str:
    lo, hi = _wilson("matched", "rows")
    anyone = " OR ".join(f"coalesce({s}, false)" for s in sides)
    counts = ", ".join(f"count(*) FILTER (WHERE {s}) AS {s}" for s in sides)
    return f"""SELECT source, rows, matched, {", ".join(sides)}, round(matched * 1.0 / rows, 6) AS rate, round({lo}, 6) AS lo, round({hi}, 6) AS hi FROM (
SELECT source, count(*) AS rows, count(*) FILTER (WHERE {anyone}) AS matched, {counts} FROM ({inner}) h {group}) t"""


def _has(expr: str, pattern: str) -> str:
    return f"contains(lower({expr}), '{pattern}')"


_PAIR = """(SELECT *, greatest(0, least(coalesce(list_position(same, false) - 1, least(len(chosen), len(rejected))), len(chosen) - 1, len(rejected) - 1)) AS b,
  coalesce(list_position(same, false) - 1, least(len(chosen), len(rejected))) AS whole FROM (
  SELECT *, list_transform(list_zip(chosen, rejected), lambda z: coalesce(z[1].role, '') = coalesce(z[2].role, '') AND coalesce(z[1].content, '') = coalesce(z[2].content, '')) AS same FROM dpo_rows) x)"""


def _dpo_hits(pattern: str) -> str:
    c = _has("m.content", pattern)
    return f"""SELECT row_id, {_src("dataset_source")} AS source,
  coalesce({_has("prompt", pattern)}, false) OR len(list_filter(chosen[1:b], lambda m: {c})) > 0 OR len(list_filter(chosen[b + 1:], lambda m: NOT {_EMITS} AND {c})) > 0 OR len(list_filter(rejected[b + 1:], lambda m: NOT {_EMITS} AND {c})) > 0 AS prompt,
  len(list_filter(chosen[b + 1:], lambda m: {_EMITS} AND {c})) > 0 AS chosen, len(list_filter(rejected[b + 1:], lambda m: {_EMITS} AND {c})) > 0 AS rejected FROM {_PAIR} p"""


def _sft_hits(pattern: str) -> str:
    return f"""SELECT row_id, {_src("source_dataset")} AS source,
  len(list_filter(messages, lambda m: (NOT {_EMITS} AND {_has("m.content", pattern)}) OR {_has("m.functions", pattern)})) > 0 AS prompt,
  len(list_filter(messages, lambda m: ({_EMITS} AND {_has("m.content", pattern)}) OR {_has("m.function_calls", pattern)})) > 0 AS response FROM sft_rows"""


def _rl_hits(pattern: str) -> str:
    return f"""SELECT row_id, {_src("dataset_source")} AS source,
  coalesce({_has("prompt", pattern)}, false) OR coalesce(len(list_filter(source_prompt, lambda m: {_has("m.content", pattern)})) > 0, false) AS prompt,
  coalesce(len(list_filter(ground_truth, lambda t: {_has("t", pattern)})) > 0, false) OR coalesce({_has("reward_model.ground_truth", pattern)}, false) AS reference,
  coalesce(len(list_filter(outputs, lambda t: {_has("t", pattern)})) > 0, false) AS rollout FROM rl_rows"""


def _chat_hits(pattern: str) -> str:
    return f"""SELECT row_id, {_src("model")} AS source, coalesce(len(list_filter(conversation, lambda m: NOT {_EMITS} AND {_has("m.content", pattern)})) > 0, false) AS prompt,
  coalesce(len(list_filter(conversation, lambda m: {_EMITS} AND {_has("m.content", pattern)})) > 0, false) AS response FROM chat_rows"""


# --------------------------------------------------------------------------------------------------------------- scans


@_query("grep_by_source", _totals_sql(_sft_hits("routing table"), ["prompt", "response"]), "sft_rows")
def _(sft: DataFrame) -> DataFrame:
    return _rounded(grep.totals(grep.hits(sft, "row_id", ["source_dataset"], text.literal_test("routing table"))), "rate", "lo", "hi")


@_query("grep_rollup", _totals_sql(_sft_hits("routing table"), ["prompt", "response"], "GROUP BY ROLLUP (source)"), "sft_rows")
def _(sft: DataFrame) -> DataFrame:
    return _rounded(grep.totals(grep.hits(sft, "row_id", ["source_dataset"], text.literal_test("Routing Table")), rollup=True), "rate", "lo", "hi")


@_query("grep_pairs", _totals_sql(_dpo_hits("loss curve"), ["prompt", "chosen", "rejected"]), "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return _rounded(grep.totals(grep.hits(dpo, "row_id", ["dataset_source"], text.literal_test("loss curve"))), "rate", "lo", "hi")


@_query("grep_rl", _totals_sql(_rl_hits("checkpoint"), ["prompt", "reference", "rollout"]), "rl_rows")
def _(rl: DataFrame) -> DataFrame:
    return _rounded(grep.totals(grep.hits(rl, "row_id", ["dataset_source"], text.literal_test("checkpoint"))), "rate", "lo", "hi")


@_query("grep_chat", _totals_sql(_chat_hits("short poem"), ["prompt", "response"]), "chat_rows")
def _(chat: DataFrame) -> DataFrame:
    return _rounded(grep.totals(grep.hits(chat, "row_id", ["model"], text.literal_test("short poem"))), "rate", "lo", "hi")


@_query("grep_prompt_only", f"SELECT source, count(*) AS rows, count(*) FILTER (WHERE prompt) AS matched FROM ({_rl_hits('checkpoint')}) h GROUP BY source", "rl_rows")
def _(rl: DataFrame) -> DataFrame:
    plan = fields.text_plan(rl.schema, ("prompt",))
    return grep.totals(grep.hits(rl, "row_id", ["dataset_source"], text.literal_test("checkpoint"), plan)).select("source", "rows", "matched")


@_query(
    "grep_case_sensitive",
    f"SELECT {_src('source')} AS source, count(*) AS rows, count(*) FILTER (WHERE contains(text, 'Run ')) AS matched FROM documents GROUP BY 1",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    test = text.literal_test("Run ", case_sensitive=True)
    return docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(test(F.col("text"))).alias("matched"))


@_query(
    "grep_regex",
    f"SELECT {_src('source')} AS source, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, '(run|job|ticket) [0-9a-f]{{5}}', 'i')) AS matched FROM documents GROUP BY 1",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    test = text.regex_test(r"(run|job|ticket) [0-9a-f]{5}")
    return docs.groupBy(fields.source_label(docs, ["source"]).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(test(F.col("text"))).alias("matched"))


_SNIP = """SELECT {keys}, CASE WHEN p > 0 THEN (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(text, CAST(s AS BIGINT), 240) || (CASE WHEN s + 239 < length(text) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT *, greatest(1, p - {half}) AS s FROM (SELECT *, strpos(lower(text), '{pattern}') AS p FROM ({inner}) a) b) c WHERE p > 0"""


@_query("snippet_window", _SNIP.format(keys="doc_id", half=(240 - 10) // 2, pattern="short poem", inner="SELECT doc_id, text FROM documents"), "documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.snippet(F.col("text"), "short poem").alias("snippet")).where("snippet is not null")


_SFT_FIELDS = f"""SELECT row_id, {_EMITS} AS emitted, m.content AS text FROM (SELECT row_id, unnest(messages) AS m FROM sft_rows) u WHERE m.content IS NOT NULL"""


@_query(
    "grep_examples",
    f"""SELECT side, rank, row, snippet FROM (SELECT side, row, snippet, row_number() OVER (PARTITION BY side ORDER BY md5(snippet), snippet) AS rank FROM (
SELECT CASE WHEN emitted THEN 'response' ELSE 'prompt' END AS side, min(row_id) AS row, snippet FROM ({_SNIP.format(keys="row_id, emitted", half=(240 - 11) // 2, pattern="bread recip", inner=_SFT_FIELDS)}) s GROUP BY 1, 3) g) r WHERE rank <= 5""",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    plain = sft.select("row_id", "source_dataset", F.transform(F.arrays_zip(F.col("messages.role").alias("role"), F.col("messages.content").alias("content")), lambda m: m).alias("messages"))
    return grep.examples(plain, "row_id", ["source_dataset"], "bread recip", text.literal_test("bread recip")).withColumn("rank", F.col("rank").cast("long"))


@_query("source_totals", f"SELECT {_src('dataset_source')} AS source, count(*) AS rows FROM dpo_rows GROUP BY 1", "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return dpo.groupBy(fields.source_label(dpo, ["dataset_source"]).alias("source")).agg(F.count(F.lit(1)).alias("rows"))


@_query(
    "column_statistics",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS rows, sum(count(*)) OVER () AS counted FROM chat_rows GROUP BY 2" for c in ("model", "language", "country", "state")).replace("sum(count(*)) OVER ()", "CAST(sum(count(*)) OVER () AS BIGINT)"),
    "chat_rows",
)
def _(chat: DataFrame) -> DataFrame:
    cols = ["model", "language", "country", "state"]
    each = chat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("v")).select("v.*")
    return each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")).withColumn("counted", F.sum("rows").over(Window.partitionBy("column")))


@_query(
    "field_inventory",
    """SELECT side, field, count(*) AS texts, count(DISTINCT row) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
SELECT row_id AS row, 'prompt' AS side, 'prompt' AS field, prompt AS text FROM rl_rows UNION ALL SELECT row_id, 'reference', 'ground_truth', unnest(ground_truth) FROM rl_rows
UNION ALL SELECT row_id, 'rollout', 'outputs', unnest(outputs) FROM rl_rows UNION ALL SELECT row_id, 'reference', 'reward_model.ground_truth', reward_model.ground_truth FROM rl_rows
UNION ALL SELECT row_id, 'prompt', 'source_prompt', unnest(source_prompt).content FROM rl_rows) x WHERE text IS NOT NULL GROUP BY 1, 2""",
    "rl_rows",
)
def _(rl: DataFrame) -> DataFrame:
    long = fields.field_rows(rl, "row_id", ["dataset_source"])
    return long.groupBy("side", "field").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("row").alias("rows"), F.sum(F.length("text")).alias("chars"))


@_query(
    "first_prompt",
    r"""SELECT row_id, regexp_replace(list_filter(messages, lambda m: m.role = 'user' AND length(regexp_replace(m.content, '^[\s\p{Z}\x0b\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x0b\x{1c}-\x{1f}\x{85}]+$', '', 'g')) > 0)[1].content, '^[\s\p{Z}\x0b\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x0b\x{1c}-\x{1f}\x{85}]+$', '', 'g') AS prompt FROM sft_rows""",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    return sft.select("row_id", fields.first_prompt(sft).alias("prompt"))


# --------------------------------------------------------------------------------------------------------------- roles

_ROLES = "SELECT row_id, source_dataset, unnest(list_distinct(list_transform(messages, lambda m: CASE WHEN trim(coalesce(m.role, '')) = '' THEN '(no role)' ELSE lower(trim(m.role)) END))) AS role FROM sft_rows"


@_query("role_census", f"SELECT role, count(*) AS rows, (SELECT count(*) FROM sft_rows WHERE len(messages) > 0) AS rows_with_turns FROM ({_ROLES}) r GROUP BY role", "sft_rows")
def _(sft: DataFrame) -> DataFrame:
    role = F.transform(F.col("messages.role"), lambda r: F.coalesce(F.nullif(F.lower(F.trim(r)), F.lit("")), F.lit("(no role)")))
    some = sft.agg(F.count_if(F.size("messages") > 0).alias("rows_with_turns"))
    return sft.select("row_id", F.explode(F.array_distinct(role)).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(some), how="cross")


_SYSTEM = "SELECT row_id, coalesce(nullif(source_dataset, ''), '(no source value)') AS source, list_filter(messages, lambda m: lower(trim(coalesce(m.role, ''))) = 'system' AND m.content IS NOT NULL)[1].content AS s FROM sft_rows"


@_query(
    "system_prompt_groups",
    f"SELECT substr(s, 1, 200) AS opening, count(*) AS rows, count(DISTINCT s) AS distinct_prompts, CAST(min(length(s)) AS INTEGER) AS shortest, CAST(max(length(s)) AS INTEGER) AS longest, count(DISTINCT source) AS sources FROM ({_SYSTEM}) x WHERE s IS NOT NULL GROUP BY 1 ORDER BY rows DESC, opening LIMIT 20",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("messages.role").alias("r"), F.col("messages.content").alias("t"))
    first = F.get(F.filter(zipped, lambda m: (F.lower(F.trim(m["r"])) == "system") & m["t"].isNotNull()), 0)["t"]
    s = sft.select(fields.source_label(sft, ["source_dataset"]).alias("source"), first.alias("s")).where("s is not null")
    one = s.groupBy(F.left("s", F.lit(200)).alias("opening")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.sha2("s", 256)).alias("distinct_prompts"), F.min(F.length("s")).alias("shortest"), F.max(F.length("s")).alias("longest"), F.countDistinct("source").alias("sources")
    )
    return one.orderBy(F.desc("rows"), "opening").limit(20)


# --------------------------------------------------------------------------------------------------------------- pairs

_LENGTHS = f"""SELECT row_id, prompt, dataset_source, preference_type, chosen_model, rejected_model, CAST(b AS INTEGER) AS shared, CAST(whole AS INTEGER) AS shared_whole, CAST(coalesce(list_sum(list_transform(chosen[b + 1:], lambda m: length(coalesce(m.content, '')))), 0) AS BIGINT) AS chosen_chars,
  CAST(coalesce(list_sum(list_transform(rejected[b + 1:], lambda m: length(coalesce(m.content, '')))), 0) AS BIGINT) AS rejected_chars FROM {_PAIR} p"""
_DELTA = f"(SELECT *, chosen_chars - rejected_chars AS delta FROM ({_LENGTHS}) l)"
_KEEP = ["row_id", "dataset_source", "preference_type"]


def _rule_sql(by: str, inner: str) -> str:
    lo, hi = _wilson("longer", "decided")
    return f"SELECT {by}, pairs, ties, longer, decided, CASE WHEN decided > 0 THEN round(longer * 1.0 / decided, 6) END AS rate, round({lo}, 6) AS lo, round({hi}, 6) AS hi FROM (SELECT {by}, count(*) AS pairs, count(*) FILTER (WHERE delta = 0) AS ties, count(*) FILTER (WHERE delta > 0) AS longer, count(*) FILTER (WHERE delta <> 0) AS decided FROM {inner} d GROUP BY {by}) r"


@_query("pair_branch_point", f"SELECT row_id, shared, shared_whole, chosen_chars, rejected_chars FROM ({_LENGTHS}) l", "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return preference.pair_lengths(dpo, ["row_id"]).drop("delta")


@_query("pair_length_rule", _rule_sql("preference_type", _DELTA), "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return preference.length_rule(preference.pair_lengths(dpo, _KEEP), ["preference_type"])


@_query(
    "pair_breakdown",
    "SELECT \"column\", value, pairs, longer, rate, lo, hi FROM (SELECT *, count(*) OVER (PARTITION BY \"column\") AS k FROM ("
    + _rule_sql('"column", value', f"(SELECT 'dataset_source' AS \"column\", dataset_source AS value, delta FROM {_DELTA} a WHERE delta <> 0 AND dataset_source <> '' UNION ALL SELECT 'preference_type', preference_type, delta FROM {_DELTA} b WHERE delta <> 0 AND preference_type <> '')")
    + ") z) y WHERE k BETWEEN 2 AND 40",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    return preference.breakdown(preference.pair_lengths(dpo, _KEEP), ["dataset_source", "preference_type"])


@_query(
    "pair_length_summary",
    f"SELECT preference_type, count(*) AS pairs, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.1), 6) AS p10, round(quantile_cont(delta, 0.5), 6) AS p50, round(quantile_cont(delta, 0.9), 6) AS p90, max(delta) AS longest FROM {_DELTA} d GROUP BY 1",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    q = F.percentile("delta", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = preference.pair_lengths(dpo, _KEEP).groupBy("preference_type").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("delta"), 6).alias("mean"), q.alias("q"), F.max("delta").alias("longest"))
    return s.select("preference_type", "pairs", "mean", *[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "longest")


@_query("pair_signed_histogram", f"SELECT CAST(sign(delta) AS INTEGER) AS sign, CAST(least(greatest(floor((log10(abs(delta)) - 1) / 0.5), 0), 10) AS INTEGER) AS bin, count(*) AS pairs FROM {_DELTA} d WHERE delta <> 0 GROUP BY 1, 2", "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return preference.signed_histogram(preference.pair_lengths(dpo, _KEEP), "delta")


@_query("pair_matchups", "SELECT chosen_model, rejected_model, count(*) AS pairs FROM dpo_rows GROUP BY 1, 2", "dpo_rows")
def _(dpo: DataFrame) -> DataFrame:
    return preference.matchups(dpo)


@_query(
    "pair_model_rule",
    """WITH m AS (SELECT chosen_model c, rejected_model r, count(*) AS n FROM dpo_rows GROUP BY 1, 2), d AS (SELECT least(c, r) a, greatest(c, r) b, max(n) AS k, sum(n) AS n FROM m WHERE c <> r AND length(c) > 0 AND length(r) > 0 GROUP BY 1, 2)
SELECT CAST(sum(k) AS BIGINT) AS "right", CAST(sum(n) AS BIGINT) AS decided, count(*) AS matchups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM m WHERE c = r AND length(c) > 0) AS same_model,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM m WHERE c IS NULL OR r IS NULL OR c = '' OR r = '') AS unknown, round(sum(k) * 1.0 / sum(n), 6) AS rate FROM d""",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    return preference.model_rule(dpo)


@_query(
    "pair_split_counts",
    f"SELECT count(*) FILTER (WHERE chosen AND NOT rejected) AS chosen_only, count(*) FILTER (WHERE rejected AND NOT chosen) AS rejected_only, count(*) FILTER (WHERE chosen AND rejected) AS both, count(*) FILTER (WHERE NOT chosen AND NOT rejected) AS neither FROM ({_dpo_hits('loss curve')}) h",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    h = grep.hits(dpo, "row_id", ["dataset_source"], text.literal_test("loss curve"))
    c, r = F.col("chosen"), F.col("rejected")
    return h.agg(F.count_if(c & ~r).alias("chosen_only"), F.count_if(~c & r).alias("rejected_only"), F.count_if(c & r).alias("both"), F.count_if(~c & ~r).alias("neither"))


@_query(
    "reasoning_split",
    r"""SELECT row_id, side, turn, CASE WHEN contains(t, '</think>') THEN length(regexp_replace(split_part(t, '</think>', 1), '^\s*<think>', '')) END AS reasoning_chars,
CASE WHEN contains(t, '</think>') THEN length(regexp_replace(t, '(?s)\A.*?</think>\s*', '')) ELSE length(t) END AS answer_chars FROM (
SELECT row_id, 'chosen' AS side, CAST(i - 1 AS INTEGER) AS turn, chosen[i].content AS t, chosen[i].role AS r FROM (SELECT row_id, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM dpo_rows) x) y WHERE lower(r) IN ('assistant', 'model') AND t IS NOT NULL""",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    t = dpo.select("row_id", F.lit("chosen").alias("side"), F.posexplode(F.arrays_zip(F.col("chosen.role").alias("r"), F.col("chosen.content").alias("t"))).alias("turn", "m")).where(fields.emits(F.col("m.r")) & F.col("m.t").isNotNull())
    return t.select("row_id", "side", "turn", F.length(text.before_think(F.col("m.t"))).cast("long").alias("reasoning_chars"), F.length(text.after_think(F.col("m.t"))).cast("long").alias("answer_chars"))


# ------------------------------------------------------------------------------------------------------- contamination

_PROBES = r"""(SELECT item_id, part, w[CAST(floor((len(w) - least(len(w), 13)) / 2) AS BIGINT) + 1:CAST(floor((len(w) - least(len(w), 13)) / 2) AS BIGINT) + least(len(w), 13)] AS words FROM (
SELECT item_id, part, list_filter(regexp_split_to_array(lower(body), '[\t\n\f\r ]+'), lambda x: length(x) > 0) AS w FROM (SELECT item_id, 'question' AS part, question AS body FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items) a WHERE body IS NOT NULL) b WHERE len(w) >= 8)"""
_HITS = f"""(SELECT DISTINCT doc_id, item_id, part FROM documents d JOIN (SELECT item_id, part, (CASE WHEN regexp_matches(words[1], '^[0-9a-z_]') THEN '\\b' ELSE '' END) || array_to_string(list_transform(words, lambda x: regexp_escape(x)), '[\\t\\n\\f\\r ]+') || (CASE WHEN regexp_matches(words[-1], '[0-9a-z_]$') THEN '\\b' ELSE '' END) AS rx,
  words[CAST(len(words) / 2 AS BIGINT)] AS mid FROM {_PROBES} p) q ON contains(lower(d.text), q.mid) AND regexp_matches(d.text, q.rx, 'i'))"""


@_query("probe_cut", f"SELECT item_id, part, CAST(len(words) AS INTEGER) AS words, array_to_string(words, ' ') AS probe FROM {_PROBES} p", "eval_items")
def _(items: DataFrame) -> DataFrame:
    return contamination.probes(items).select("item_id", "part", F.size("words").alias("words"), "probe")


@_query("contaminate_hits", f"SELECT doc_id, item_id, part FROM {_HITS} h", "documents", "eval_items")
def _(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination.probe_hits(docs, ["doc_id"], "text", contamination.probes(items))


_LO, _HI = _wilson("seen", "items")


@_query(
    "contaminate_items",
    f"""SELECT benchmark, items, seen, question_seen, answer_seen, round({_LO}, 6) AS lo, round({_HI}, 6) AS hi FROM (SELECT benchmark, count(*) AS items, count(*) FILTER (WHERE q OR a) AS seen, count(*) FILTER (WHERE q) AS question_seen, count(*) FILTER (WHERE a) AS answer_seen FROM eval_items
LEFT JOIN (SELECT item_id, bool_or(part = 'question') AS q, bool_or(part = 'answer') AS a FROM {_HITS} h GROUP BY 1) s USING (item_id) GROUP BY 1) t""",
    "documents",
    "eval_items",
)
def _(docs: DataFrame, items: DataFrame) -> DataFrame:
    return _rounded(contamination.item_rollup(contamination.probe_hits(docs, ["doc_id"], "text", contamination.probes(items)), items), "lo", "hi")


# ---------------------------------------------------------------------------------------------------------- statistics

_RATE = f"(SELECT {_src('source')} AS source, shard, contains(lower(coalesce(text, '')), 'bus timetable') AS hit FROM documents)"


@_query(
    "cluster_wilson_by_source",
    f"""SELECT source, clusters, n, k, round(n_eff, 6) AS n_effective, round({_wilson("(k * n_eff / n)", "n_eff")[0]}, 6) AS lo, round({_wilson("(k * n_eff / n)", "n_eff")[1]}, 6) AS hi FROM (
SELECT *, CASE WHEN clusters < 2 OR k = 0 OR k = n THEN clusters * 1.0 ELSE greatest(1.0, n / greatest(1.0, (clusters * ss / ((clusters - 1.0) * n * n)) / ((k * 1.0 / n) * (1 - k * 1.0 / n) / n))) END AS n_eff FROM (
SELECT source, count(*) AS clusters, CAST(sum(m) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS k, sum(pow(y - p * m, 2)) AS ss FROM (SELECT *, sum(y) OVER (PARTITION BY source) * 1.0 / sum(m) OVER (PARTITION BY source) AS p FROM (
SELECT source, shard, count(*) AS m, count(*) FILTER (WHERE hit) AS y FROM {_RATE} r GROUP BY 1, 2) c) d GROUP BY source) e) f""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    hit = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("bus timetable"))
    c = docs.groupBy(fields.source_label(docs, ["source"]).alias("source"), "shard").agg(F.count(F.lit(1)).alias("m"), F.count_if(hit).alias("y"))
    w = Window.partitionBy("source")
    c = c.withColumn("p", F.sum("y").over(w) / F.sum("m").over(w))
    s = c.groupBy("source").agg(F.count(F.lit(1)).alias("clusters"), F.sum("m").alias("n"), F.sum("y").alias("k"), F.sum(F.pow(F.col("y") - F.col("p") * F.col("m"), 2)).alias("ss"))
    s = s.withColumn("ne", stats.cluster_effective_n(F.col("clusters"), F.col("n"), F.col("k"), F.col("ss")))
    lo, hi = stats.wilson(F.col("k") * F.col("ne") / F.col("n"), F.col("ne"))
    return s.select("source", "clusters", "n", "k", F.round("ne", 6).alias("n_effective"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@_query(
    "cluster_se_mean",
    f"""SELECT source, count(*) AS clusters, CAST(sum(m) AS BIGINT) AS n, round(max(mean), 6) AS mean, CASE WHEN count(*) > 1 THEN round(sqrt(count(*) / (count(*) - 1.0) * sum(pow(t - mean * m, 2))) / sum(m), 6) END AS se FROM (
SELECT *, sum(t) OVER (PARTITION BY source) * 1.0 / sum(m) OVER (PARTITION BY source) AS mean FROM (SELECT {_src('source')} AS source, shard, count(*) AS m, sum(n_chars) AS t FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2) c) d GROUP BY source""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    c = docs.where("n_chars is not null").groupBy(fields.source_label(docs, ["source"]).alias("source"), "shard").agg(F.count(F.lit(1)).alias("m"), F.sum("n_chars").alias("t"))
    w = Window.partitionBy("source")
    c = c.withColumn("mean", F.sum("t").over(w) / F.sum("m").over(w))
    n = F.count(F.lit(1))
    se = F.when(n > 1, F.round(F.sqrt(n / F.nullif(n - 1, F.lit(0)) * F.sum(F.pow(F.col("t") - F.col("mean") * F.col("m"), 2))) / F.sum("m"), 6))
    return c.groupBy("source").agg(n.alias("clusters"), F.sum("m").alias("n"), F.round(F.max("mean"), 6).alias("mean"), se.alias("se"))


@_query("length_histogram", "SELECT coalesce(domain, '(none)') AS domain, CAST(least(greatest(floor((log10(n_chars) - 1) / 0.5), 0), 10) AS INTEGER) AS bin, count(*) AS documents FROM documents WHERE n_chars > 0 GROUP BY 1, 2", "documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.where("n_chars > 0").groupBy(F.coalesce("domain", F.lit("(none)")).alias("domain"), stats.half_decade(F.col("n_chars")).alias("bin")).agg(F.count(F.lit(1)).alias("documents"))


@_query(
    "length_quantiles",
    "SELECT coalesce(domain, '(none)') AS domain, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS longest FROM documents GROUP BY 1",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    q = F.percentile("n_chars", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = docs.groupBy(F.coalesce("domain", F.lit("(none)")).alias("domain")).agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), q.alias("q"), F.max("n_chars").alias("longest"))
    return s.select("domain", "n", "mean", *[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "longest")


@_query(
    "target_chars",
    f"""SELECT 'sft' AS stage, {_src('source_dataset')} AS source, count(*) AS rows, CAST(sum(coalesce(list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))), 0)) AS BIGINT) AS chars,
  CAST(sum(coalesce(list_sum(list_transform(messages, lambda m: CASE WHEN {_EMITS} THEN length(coalesce(m.content, '')) ELSE 0 END)), 0)) AS BIGINT) AS target_chars FROM sft_rows GROUP BY 2
UNION ALL SELECT 'dpo', {_src('dataset_source')}, count(*), CAST(sum(chosen_chars + rejected_chars + coalesce(length(prompt), 0)) AS BIGINT), CAST(sum(chosen_chars + rejected_chars) AS BIGINT) FROM ({_LENGTHS}) l GROUP BY 2
UNION ALL SELECT 'rlvr', {_src('dataset_source')}, count(*), CAST(sum(coalesce(length(prompt), 0)) AS BIGINT), CAST(0 AS BIGINT) FROM rl_rows GROUP BY 2""",
    "sft_rows",
    "dpo_rows",
    "rl_rows",
)
def _(sft: DataFrame, dpo: DataFrame, rl: DataFrame) -> DataFrame:
    zipped = F.coalesce(F.arrays_zip(F.col("messages.role").alias("r"), F.transform(F.col("messages.content"), lambda t: F.coalesce(F.length(t), F.lit(0))).alias("n")), F.array().cast("array<struct<r:string,n:int>>"))
    total = F.aggregate(zipped, F.lit(0).cast("long"), lambda a, m: a + m["n"])
    target = F.aggregate(zipped, F.lit(0).cast("long"), lambda a, m: a + F.when(fields.emits(m["r"]), m["n"]).otherwise(0))
    a = sft.select(F.lit("sft").alias("stage"), fields.source_label(sft, ["source_dataset"]).alias("source"), total.alias("chars"), target.alias("target"))
    p = preference.pair_lengths(dpo, ["row_id", "dataset_source", "prompt"])
    both = F.col("chosen_chars") + F.col("rejected_chars")
    b = p.select(F.lit("dpo").alias("stage"), fields.source_label(p, ["dataset_source"]).alias("source"), (both + F.coalesce(F.length("prompt"), F.lit(0))).alias("chars"), both.alias("target"))
    c = rl.select(F.lit("rlvr").alias("stage"), fields.source_label(rl, ["dataset_source"]).alias("source"), F.coalesce(F.length("prompt"), F.lit(0)).cast("long").alias("chars"), F.lit(0).cast("long").alias("target"))
    return a.unionByName(b).unionByName(c).groupBy("stage", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"), F.sum("target").alias("target_chars"))


@_query(
    "char_weighted_rate",
    f"SELECT {_src('source')} AS source, round(sum(CASE WHEN contains(lower(text), 'bus timetable') THEN length(text) ELSE 0 END) * 1.0 / sum(length(text)), 6) AS weighted, round(count(*) FILTER (WHERE contains(lower(text), 'bus timetable')) * 1.0 / count(text), 6) AS plain FROM documents WHERE length(text) > 0 GROUP BY 1",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    hit, n = F.contains(F.lower("text"), F.lit("bus timetable")), F.length("text")
    d = docs.where("length(text) > 0")
    return d.groupBy(fields.source_label(d, ["source"]).alias("source")).agg(F.round(F.sum(F.when(hit, n).otherwise(0)) / F.sum(n), 6).alias("weighted"), F.round(F.count_if(hit) / F.count("text"), 6).alias("plain"))


@_query(
    "budget_rollup",
    """SELECT family, domain, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN hit THEN length(text) ELSE 0 END) AS BIGINT) AS matching_chars, round(sum(length(text)) / 4.0, 6) AS tokens_estimate FROM (
SELECT coalesce(nullif(source, ''), '(no source value)') AS family, coalesce(domain, '(none)') AS domain, text, contains(lower(text), 'bus timetable') AS hit FROM documents WHERE length(text) > 0) d GROUP BY ROLLUP (family, domain)""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    d = docs.where("length(text) > 0").select(fields.source_label(docs, ["source"]).alias("family"), F.coalesce("domain", F.lit("(none)")).alias("domain"), F.length("text").alias("n"), F.contains(F.lower("text"), F.lit("bus timetable")).alias("hit"))
    return d.rollup("family", "domain").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("matching_chars"), F.round(F.sum("n") / 4.0, 6).alias("tokens_estimate"))


# ----------------------------------------------------------------------------------------------------------- agreement

_RATERS = "(SELECT row_id, CASE WHEN toxic THEN 'toxic' ELSE 'clean' END AS a, CASE WHEN openai_moderation IS NULL THEN NULL WHEN len(list_filter(openai_moderation, lambda m: m.flagged)) > 0 THEN 'toxic' ELSE 'clean' END AS b FROM chat_rows WHERE toxic IS NOT NULL)"


def _raters(chat: DataFrame) -> DataFrame:
    flagged = F.exists(F.col("openai_moderation.flagged"), lambda x: F.coalesce(x, F.lit(False)))
    return chat.where("toxic is not null").select(
        "row_id", F.when(F.col("toxic"), "toxic").otherwise("clean").alias("a"), F.when(F.col("openai_moderation").isNull(), None).when(flagged, "toxic").otherwise("clean").alias("b")
    )


@_query("label_confusion", f"SELECT a, b, count(*) AS rows FROM {_RATERS} r GROUP BY 1, 2", "chat_rows")
def _(chat: DataFrame) -> DataFrame:
    return _raters(chat).groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"))


@_query(
    "label_kappa",
    f"""WITH p AS (SELECT a, b FROM {_RATERS} r WHERE b IS NOT NULL), e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a, count(*) AS n FROM p GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM p GROUP BY 1) y ON x.a = y.b)
SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, round((count(*) FILTER (WHERE a = b) * 1.0 / count(*) - max(e) * 1.0 / (count(*) * count(*))) / (1 - max(e) * 1.0 / (count(*) * count(*))), 6) AS kappa FROM p, e""",
    "chat_rows",
)
def _(chat: DataFrame) -> DataFrame:
    cells = _raters(chat).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    a, b = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = a.join(b, a["a"] == b["b"]).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("e"))
    s = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree")).join(chance, how="cross")
    return s.select("n", "agree", F.round(stats.kappa(F.col("agree"), F.col("n"), F.col("e")), 6).alias("kappa"))


@_query(
    "label_precision_recall",
    f"""SELECT label, both_n, CASE WHEN b_n > 0 THEN round(both_n * 1.0 / b_n, 6) END AS precision, CASE WHEN a_n > 0 THEN round(both_n * 1.0 / a_n, 6) END AS recall FROM (
SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS both_n, count(*) FILTER (WHERE a = label) AS a_n, count(*) FILTER (WHERE b = label) AS b_n FROM {_RATERS} r, (VALUES ('toxic'), ('clean')) l(label) WHERE b IS NOT NULL GROUP BY 1) t""",
    "chat_rows",
)
def _(chat: DataFrame) -> DataFrame:
    cells = _raters(chat).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("n", "a", "b", F.explode(F.array(F.lit("toxic"), F.lit("clean"))).alias("label"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    mine, theirs = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    s = each.groupBy("label").agg(count(mine & theirs).alias("both_n"), count(mine).alias("an"), count(theirs).alias("bn"))
    return s.select("label", "both_n", F.round(F.try_divide(F.col("both_n").cast("double"), F.col("bn").cast("double")), 6).alias("precision"), F.round(F.try_divide(F.col("both_n").cast("double"), F.col("an").cast("double")), 6).alias("recall"))


@_query("label_shares", "SELECT country, label, count(*) AS rows, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY country), 6) AS share FROM (SELECT country, CASE WHEN toxic THEN 'toxic' ELSE 'clean' END AS label FROM chat_rows WHERE toxic IS NOT NULL) r GROUP BY 1, 2", "chat_rows")
def _(chat: DataFrame) -> DataFrame:
    g = chat.where("toxic is not null").groupBy("country", F.when(F.col("toxic"), "toxic").otherwise("clean").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("country")), 6))


@_query(
    "label_crosstab",
    "SELECT language, count(*) FILTER (WHERE toxic) AS toxic, count(*) FILTER (WHERE NOT toxic) AS clean FROM chat_rows GROUP BY 1",
    "chat_rows",
)
def _(chat: DataFrame) -> DataFrame:
    p = chat.groupBy("language").pivot("toxic", [True, False]).count()
    return p.select("language", F.coalesce("true", F.lit(0)).cast("long").alias("toxic"), F.coalesce("false", F.lit(0)).cast("long").alias("clean"))


# ----------------------------------------------------------------------------------------------------- joins and sets


@_query(
    "prefix_backfill",
    """SELECT d.row_id, p.full_text FROM (SELECT row_id, substr(prompt, 1, 200) AS prefix FROM dpo_rows WHERE prompt IS NOT NULL) d JOIN (
SELECT substr(prompt, 1, 200) AS prefix, min(prompt) AS full_text FROM rl_rows WHERE prompt IS NOT NULL GROUP BY 1 HAVING count(DISTINCT prompt) = 1) p USING (prefix)""",
    "dpo_rows",
    "rl_rows",
)
def _(dpo: DataFrame, rl: DataFrame) -> DataFrame:
    key = F.left("prompt", F.lit(200)).alias("prefix")
    sure = rl.where("prompt is not null").groupBy(key).agg(F.countDistinct("prompt").alias("n"), F.min("prompt").alias("full_text")).where("n = 1")
    return dpo.where("prompt is not null").select("row_id", key).join(sure, "prefix").select("row_id", "full_text")


@_query(
    "record_join",
    """SELECT s.row_id, c.first_row AS context_row FROM (SELECT row_id, id FROM sft_rows) s LEFT JOIN (SELECT id, min(row_id) AS first_row FROM sft_rows GROUP BY 1) c USING (id)""",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    first = sft.groupBy("id").agg(F.min("row_id").alias("context_row"))
    return sft.select("row_id", "id").join(first, "id", "left").select("row_id", "context_row")


@_query(
    "key_overlap",
    """SELECT (SELECT count(*) FROM (SELECT prompt FROM dpo_rows WHERE prompt IS NOT NULL INTERSECT SELECT prompt FROM rl_rows)) AS shared, (SELECT count(*) FROM (SELECT prompt FROM dpo_rows WHERE prompt IS NOT NULL EXCEPT SELECT prompt FROM rl_rows)) AS only_first,
(SELECT count(*) FROM (SELECT prompt FROM rl_rows WHERE prompt IS NOT NULL EXCEPT SELECT prompt FROM dpo_rows)) AS only_second""",
    "dpo_rows",
    "rl_rows",
)
def _(dpo: DataFrame, rl: DataFrame) -> DataFrame:
    a, b = (x.where("prompt is not null").select(F.sha2("prompt", 256).alias("k")).distinct().withColumn(n, F.lit(1)) for x, n in ((dpo, "a"), (rl, "b")))
    j = a.join(b, "k", "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


@_query("repeated_rows", "SELECT id, count(*) AS copies, min(row_id) AS first_row FROM sft_rows GROUP BY 1 HAVING count(*) > 1", "sft_rows")
def _(sft: DataFrame) -> DataFrame:
    return sft.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_row")).where("copies > 1")


@_query(
    "latest_conversations",
    "SELECT conversation_hash, row_id, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY conversation_hash ORDER BY arrived_at DESC, row_id DESC) AS n FROM chat_rows) x WHERE n = 1",
    "chat_rows",
)
def _(chat: DataFrame) -> DataFrame:
    m = F.max(F.struct("arrived_at", "row_id"))  # an aggregate, so a hot key is combined before the shuffle
    return chat.groupBy("conversation_hash").agg(m.alias("m")).select("conversation_hash", "m.row_id", "m.arrived_at")


# -------------------------------------------------------------------------------------------------------- stage traces

_STAGES = f"""(SELECT 'sft' AS stage, count(*) AS rows, count(*) FILTER (WHERE prompt) AS prompt, count(*) FILTER (WHERE response) AS response, CAST(NULL AS BIGINT) AS chosen, CAST(NULL AS BIGINT) AS rejected, CAST(NULL AS BIGINT) AS reference, CAST(NULL AS BIGINT) AS rollout, count(*) FILTER (WHERE prompt OR response) AS matched FROM ({_sft_hits('checkpoint')}) a
UNION ALL SELECT 'dpo', count(*), count(*) FILTER (WHERE prompt), NULL, count(*) FILTER (WHERE chosen), count(*) FILTER (WHERE rejected), NULL, NULL, count(*) FILTER (WHERE prompt OR chosen OR rejected) FROM ({_dpo_hits('checkpoint')}) b
UNION ALL SELECT 'rlvr', count(*), count(*) FILTER (WHERE prompt), NULL, NULL, NULL, count(*) FILTER (WHERE reference), count(*) FILTER (WHERE rollout), count(*) FILTER (WHERE prompt OR reference OR rollout) FROM ({_rl_hits('checkpoint')}) c)"""
_PRODUCED = "coalesce(response, 0) + coalesce(chosen, 0) + coalesce(reference, 0)"
_ELSE = "prompt + coalesce(rejected, 0) + coalesce(rollout, 0)"


def _stages(sft: DataFrame, dpo: DataFrame, rl: DataFrame, pattern: str) -> DataFrame:
    out = None
    for stage, df, source in (("sft", sft, "source_dataset"), ("dpo", dpo, "dataset_source"), ("rlvr", rl, "dataset_source")):
        h = grep.hits(df, "row_id", [source], text.literal_test(pattern))
        sides = [F.count_if(s).alias(s) if s in h.columns else F.lit(None).cast("long").alias(s) for s in fields.SIDES]
        one = h.agg(F.count(F.lit(1)).alias("rows"), F.count_if("any").alias("matched"), *sides).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out


@_query(
    "stage_rank_produced",
    f"""SELECT stage, rows, matched, CAST(lo AS BIGINT) AS produced_low, CAST(hi AS BIGINT) AS produced_high, round(lo * 1.0 / rows, 6) AS rate_low, round(hi * 1.0 / rows, 6) AS rate_high, rank() OVER (ORDER BY lo * 1.0 / rows DESC) AS rank,
hi * 1.0 / rows >= max(lo * 1.0 / rows) OVER () AS contender FROM (SELECT *, least(greatest(coalesce(response, 0), coalesce(chosen, 0), coalesce(reference, 0), matched - ({_ELSE})), least(matched, {_PRODUCED})) AS lo, least(matched, {_PRODUCED}) AS hi FROM {_STAGES} s) t""",
    "sft_rows",
    "dpo_rows",
    "rl_rows",
)
def _(sft: DataFrame, dpo: DataFrame, rl: DataFrame) -> DataFrame:
    s = _stages(sft, dpo, rl, "checkpoint")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    low, high = stats.union_bounds(F.col("matched"), z("prompt") + z("rejected") + z("rollout"), [z("response"), z("chosen"), z("reference")])
    r = s.select("stage", "rows", "matched", low.alias("produced_low"), high.alias("produced_high")).withColumn("rl", F.col("produced_low") / F.col("rows")).withColumn("rh", F.col("produced_high") / F.col("rows"))
    w = Window.orderBy(F.desc("rl"))  # one row a stage
    return r.select("stage", "rows", "matched", "produced_low", "produced_high", F.round("rl", 6).alias("rate_low"), F.round("rh", 6).alias("rate_high"), F.rank().over(w).cast("long").alias("rank"), (F.col("rh") >= F.max("rl").over(Window.partitionBy())).alias("contender"))


@_query(
    "coverage_status",
    f"""SELECT c.stage, s.rows, s.matched, CASE WHEN s.stage IS NULL THEN 'unsearched' WHEN s.matched > 0 THEN 'hits' ELSE 'zero' END AS status FROM (VALUES ('pretrain'), ('sft'), ('dpo'), ('rlvr')) c(stage) LEFT JOIN {_STAGES.replace("'checkpoint'", "'checkpoint'")} s USING (stage)""",
    "sft_rows",
    "dpo_rows",
    "rl_rows",
)
def _(sft: DataFrame, dpo: DataFrame, rl: DataFrame) -> DataFrame:
    catalog = sft.sparkSession.createDataFrame([("pretrain",), ("sft",), ("dpo",), ("rlvr",)], "stage string")
    s = _stages(sft, dpo, rl, "checkpoint").select("stage", "rows", "matched")
    status = F.when(F.col("rows").isNull(), "unsearched").when(F.col("matched") > 0, "hits").otherwise("zero")
    return catalog.join(s, "stage", "left").select("stage", "rows", "matched", status.alias("status"))


@_query(
    "source_concentration",
    f"""WITH t AS (SELECT source, count(*) AS rows, count(*) FILTER (WHERE prompt OR response) AS hits FROM ({_sft_hits('isbn 978')}) h GROUP BY 1), s AS (SELECT *, hits * 1.0 / rows AS rate, (hits * 1.0 / rows) / nullif(sum(hits) OVER () * 1.0 / sum(rows) OVER (), 0) AS lift, sum(hits) OVER () AS total FROM t)
SELECT source, rows, hits, round(rate, 6) AS rate, round(lift, 6) AS lift, coalesce(hits >= greatest(2, 0.1 * total) AND lift >= 2, false) AS concentrated FROM s""",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    t = grep.totals(grep.hits(sft, "row_id", ["source_dataset"], text.literal_test("isbn 978"))).select("source", "rows", F.col("matched").alias("hits"))
    w = Window.partitionBy()  # one row a source
    s = t.withColumn("rate", F.col("hits") / F.col("rows")).withColumn("lift", F.try_divide(F.col("rate"), F.sum("hits").over(w) / F.sum("rows").over(w))).withColumn("total", F.sum("hits").over(w))
    return s.select("source", "rows", "hits", F.round("rate", 6).alias("rate"), F.round("lift", 6).alias("lift"), F.coalesce((F.col("hits") >= F.greatest(F.lit(2.0), 0.1 * F.col("total"))) & (F.col("lift") >= 2), F.lit(False)).alias("concentrated"))


# ------------------------------------------------------------------------------------------------------------ sampling


@_query("sample_hash_k", "SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50", "documents")
def _(docs: DataFrame) -> DataFrame:
    return sampling.hash_sample(docs.select("doc_id"), "doc_id", 50, 7)


@_query(
    "sample_pages",
    "SELECT row_id, row_id // 10 AS page FROM sft_rows WHERE row_id // 10 IN (SELECT page FROM (SELECT DISTINCT row_id // 10 AS page FROM sft_rows) p ORDER BY md5('3:' || CAST(page AS VARCHAR)), page LIMIT 6)",
    "sft_rows",
)
def _(sft: DataFrame) -> DataFrame:
    return sampling.page_sample(sft.select("row_id"), "row_id", 6, 3)


@_query(
    "sample_pps",
    """WITH s AS (SELECT shard, sum(coalesce(n_chars, 0)) AS size FROM documents GROUP BY 1), c AS (SELECT shard, size, sum(size) OVER (ORDER BY shard) AS hi FROM s), d AS (SELECT range AS draw, CAST(concat('0x', substr(md5('5:' || CAST(range AS VARCHAR)), 1, 12)) AS BIGINT) % (SELECT CAST(sum(size) AS BIGINT) FROM s) AS pt FROM range(40))
SELECT draw, shard FROM d JOIN c ON pt >= hi - size AND pt < hi""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    shards = docs.groupBy("shard").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("size"))
    return sampling.pps_sample(shards, "shard", "size", 40, 5)


@_query(
    "sample_stratified",
    "SELECT range AS slice, range * 10000 // 16 + CAST(concat('0x', substr(md5('9:' || CAST(range AS VARCHAR)), 1, 12)) AS BIGINT) % ((range + 1) * 10000 // 16 - range * 10000 // 16) AS step FROM range(16)",
    "events",
)
def _(events: DataFrame) -> DataFrame:
    return sampling.stratified_steps(events, "step", 10000, 16, 9)


@_query(
    "evenly_spaced_picks",
    "SELECT doc_id, shard FROM (SELECT doc_id, shard, row_number() OVER (ORDER BY shard, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) x WHERE rn IN (SELECT range * n // 25 FROM range(25))",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return sampling.even_picks(docs.select("shard", "doc_id"), ["shard", "doc_id"], 25).select("doc_id", "shard")


@_query(
    "row_clusters",
    "SELECT shard, doc_id, CAST(sum(new) OVER (PARTITION BY shard ORDER BY doc_id) AS BIGINT) AS cluster FROM (SELECT shard, doc_id, CASE WHEN doc_id - lag(doc_id) OVER (PARTITION BY shard ORDER BY doc_id) >= 10 THEN 1 ELSE 0 END AS new FROM documents) x",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return sampling.row_clusters(docs.select("shard", "doc_id"), "doc_id", ["shard"])


# --------------------------------------------------------------------------------------------------- indexes and terms

_GRAMS = "(SELECT DISTINCT item_id, substr(lower(question), CAST(i AS BIGINT), 3) AS gram FROM (SELECT item_id, question, unnest(range(1, length(question) - 1)) AS i FROM eval_items WHERE length(question) >= 3) x)"


@_query("trigram_postings", f"SELECT gram, count(*) AS items, min(item_id) AS first_item, list_sort(list(item_id)) AS postings FROM {_GRAMS} g GROUP BY 1", "eval_items")
def _(items: DataFrame) -> DataFrame:
    return terms.postings(items, "item_id", "question").drop("block")  # the items are one block


@_query("trigram_search", "SELECT item_id FROM eval_items WHERE contains(lower(question), 'lanterns')", "eval_items")
def _(items: DataFrame) -> DataFrame:
    wanted = [w for w in dict.fromkeys("lanterns"[i : i + 3] for i in range(6))]
    g = items.select("item_id", F.explode(text.trigrams(F.col("question"))).alias("gram")).where(F.col("gram").isin(wanted))
    candidates = g.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return items.join(candidates, "item_id", "left_semi").where(F.contains(F.lower("question"), F.lit("lanterns"))).select("item_id")


@_query(
    "ngram_counts",
    r"""SELECT gram, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (
SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\t\n\f\r ]+'), lambda x: length(x) > 0) AS w FROM documents WHERE text IS NOT NULL) a) b) c GROUP BY 1 HAVING count(*) >= 20""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return terms.ngram_counts(docs, "text", 3, 20)


@_query("occurrence_counts", "SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the short poem', ''))) // 14 AS occurrences FROM documents WHERE contains(lower(text), 'the short poem')", "documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.where(F.contains(F.lower("text"), F.lit("the short poem"))).select("doc_id", text.occurrences(F.col("text"), "the short poem").alias("occurrences"))


@_query(
    "domain_shares",
    "SELECT host, CAST(sum(n) AS BIGINT) AS weight, round(sum(n) * 1.0 / sum(sum(n)) OVER (), 6) AS share FROM (SELECT coalesce(regexp_replace(lower(nullif(site, '')), '^www\\.', ''), '(no url recorded)') AS host, (length(lower(text)) - length(replace(lower(text), 'the short poem', ''))) // 14 AS n FROM documents WHERE contains(lower(text), 'the short poem')) x GROUP BY 1",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    h = F.coalesce(text.host(F.concat(F.lit("http://"), F.nullif("site", F.lit("")))), F.lit("(no url recorded)"))
    g = docs.where(F.contains(F.lower("text"), F.lit("the short poem"))).groupBy(h.alias("host")).agg(F.sum(text.occurrences(F.col("text"), "the short poem")).alias("weight"))
    whole = g.agg(F.sum("weight").alias("whole"))  # one row
    return g.join(whole, how="cross").select("host", "weight", F.round(F.col("weight") / F.col("whole"), 6).alias("share"))


@_query(
    "token_search",
    "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(loss)($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])(curve)($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])(poem)($|[^a-z0-9])')",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return docs.where(F.size(F.array_except(F.array(F.lit("loss"), F.lit("curve"), F.lit("poem")), words)) == 0).select("doc_id")


@_query(
    "shard_groups",
    f"SELECT {_src('source')} AS source, coalesce(topic, '') AS topic, count(DISTINCT shard) AS shards, count(*) AS documents, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS size FROM documents GROUP BY 1, 2",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return docs.groupBy(fields.source_label(docs, ["source"]).alias("source"), F.coalesce("topic", F.lit("")).alias("topic")).agg(F.countDistinct("shard").alias("shards"), F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("size"))


@_query(
    "document_metadata",
    """SELECT doc_id, j->>'$.cc_dump' AS cc_dump, CAST(j->>'$.quality' AS DOUBLE) AS quality, CAST(j->>'$.word_count' AS BIGINT) AS word_count, CAST(j->>'$.duplicates' AS BIGINT) AS duplicates FROM (SELECT doc_id, CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END AS j FROM documents) x WHERE j IS NOT NULL""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    m = F.from_json("metadata", "cc_dump string, quality double, word_count long, duplicates long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return docs.where("metadata is not null").select("doc_id", m.alias("m")).where("m is not null and m._bad is null").select("doc_id", "m.cc_dump", "m.quality", "m.word_count", "m.duplicates")


# -------------------------------------------------------------------------------------------------------- text scalars


@_query(
    "document_excerpt",
    "SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 195) || E'\\n\\n[…]\\n\\n' || substr(text, CAST((length(text) - 195) // 2 AS BIGINT) + 1, 195) || E'\\n\\n[…]\\n\\n' || substr(text, CAST((length(text) - 195) // 2 * 2 AS BIGINT) + 1, 195) END AS excerpt FROM documents".replace("195", str((600 - 14) // 3)),
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.excerpt(F.col("text"), 600).alias("excerpt"))


@_query(
    "prompt_key",
    "SELECT row_id, CASE WHEN prompt IS NOT NULL THEN format('{:08x}', list_reduce(list_transform(range(1, length(substr(prompt, 1, 400)) + 1), lambda i: CAST(unicode(substr(prompt, i, 1)) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))) END AS key FROM dpo_rows",
    "dpo_rows",
)
def _(dpo: DataFrame) -> DataFrame:
    return dpo.select("row_id", text.fnv32(F.col("prompt")).alias("key"))


@_query(
    "strip_noise",
    r"""SELECT doc_id, length(regexp_replace(t, '[^\p{L}\p{M}]', '', 'g')) AS letters FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '(?s)\$\$.*?\$\$|\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g') AS t FROM documents) x""",
    "documents",
)
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.letters(text.strip_noise(F.col("text"))).cast("long").alias("letters"))


@_query("title_slugs", "SELECT item_id, regexp_replace(regexp_replace(lower(question), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM eval_items", "eval_items")
def _(items: DataFrame) -> DataFrame:
    return items.select("item_id", text.slug(F.col("question")).alias("slug"))


@_query("redacted_documents", "SELECT doc_id, text FROM documents", "documents")
def _(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.redact(F.col("text")).alias("text"))


# ------------------------------------------------------------------------------------------------------- ordered steps

_STEP = "(SELECT event_id // 100 AS step, count(*) AS sequences, count(*) FILTER (WHERE event_type = 'purchase' OR event_type = 'click') AS matched, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS occurrences FROM events GROUP BY 1)"


def _steps(events: DataFrame) -> DataFrame:
    return events.groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("step")).agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("event_type").isin("purchase", "click")).alias("matched"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("occurrences")
    )


@_query("step_counts", f"SELECT * FROM {_STEP} s", "events")
def _(events: DataFrame) -> DataFrame:
    return _steps(events)


_EFFECT = f"(SELECT CASE WHEN count(*) < 2 OR sum(matched) = 0 OR sum(matched) = sum(sequences) THEN 1.0 ELSE greatest(1.0, (count(*) * sum(pow(matched - p * sequences, 2)) / ((count(*) - 1.0) * sum(sequences) * sum(sequences))) / (max(p) * (1 - max(p)) / sum(sequences))) END AS deff FROM (SELECT *, sum(matched) OVER () * 1.0 / sum(sequences) OVER () AS p FROM {_STEP} s) t)"
_SL, _SH = _wilson("(k * 1.0 / deff)", "(n * 1.0 / deff)")


@_query(
    "steps_by_slice",
    f"SELECT slice, steps, n AS sequences, k AS matched, round(k * 1.0 / n, 6) AS rate, round({_SL}, 6) AS lo, round({_SH}, 6) AS hi FROM (SELECT step * 8 // (SELECT max(step) + 1 FROM {_STEP} a) AS slice, count(*) AS steps, CAST(sum(sequences) AS BIGINT) AS n, CAST(sum(matched) AS BIGINT) AS k FROM {_STEP} b GROUP BY 1) c, {_EFFECT} e",
    "events",
)
def _(events: DataFrame) -> DataFrame:
    s = _steps(events)
    total = s.agg((F.max("step") + 1).alias("total"), (F.sum("matched") / F.sum("sequences")).alias("p"))
    x = s.join(F.broadcast(total), how="cross")
    n, c = F.sum("sequences"), F.count(F.lit(1))
    effect = x.agg(F.when((c < 2) | (F.max("p") == 0) | (F.max("p") == 1), 1.0).otherwise(F.greatest(F.lit(1.0), F.try_divide(F.try_divide(c * F.sum(F.pow(F.col("matched") - F.col("p") * F.col("sequences"), 2)), (c - 1.0) * n * n), F.max("p") * (1 - F.max("p")) / n))).alias("deff"))
    g = x.groupBy(F.floor(F.col("step") * 8 / F.col("total")).cast("long").alias("slice")).agg(c.alias("steps"), n.alias("sequences"), F.sum("matched").alias("matched")).join(F.broadcast(effect), how="cross")
    lo, hi = stats.wilson(F.col("matched") / F.col("deff"), F.col("sequences") / F.col("deff"))
    return g.select("slice", "steps", "sequences", "matched", F.round(F.col("matched") / F.col("sequences"), 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@_query(
    "exposure",
    f"SELECT range * 10 AS step, range * 10 * 100 AS sequences_seen, round(range * 10 * 100 * (SELECT sum(matched) * 1.0 / sum(sequences) FROM {_STEP} s), 6) AS expected FROM range(11)",
    "events",
)
def _(events: DataFrame) -> DataFrame:
    rate = _steps(events).agg((F.sum("matched") / F.sum("sequences")).alias("rate"))
    at = events.sparkSession.range(11).select((F.col("id") * 10).alias("step"), (F.col("id") * 1000).alias("sequences_seen"))
    return at.join(F.broadcast(rate), how="cross").select("step", "sequences_seen", F.round(F.col("sequences_seen") * F.col("rate"), 6).alias("expected"))


@_query(
    "last_checkpoint",
    "SELECT event_id, greatest(0, event_id // 1000 * 1000) AS checkpoint, event_id - event_id // 1000 * 1000 AS distance FROM events",
    "events",
)
def _(events: DataFrame) -> DataFrame:
    at = F.floor(F.col("event_id") / 1000).cast("long") * 1000
    return events.select("event_id", F.greatest(F.lit(0), at).alias("checkpoint"), (F.col("event_id") - at).alias("distance"))


# ------------------------------------------------------------------------------------------------- vectors and chains

_PAIRED = "(SELECT a.vec_id // 2 AS layer, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def _paired(emb: DataFrame) -> DataFrame:
    a = emb.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).cast("long").alias("layer"), F.col("embedding").alias("x"))
    b = emb.where("vec_id % 2 = 1").select(F.floor((F.col("vec_id") - 1) / 2).cast("long").alias("layer"), F.col("embedding").alias("y"))
    return a.join(b, "layer")


def _sum(array: object) -> object:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


@_query(
    "parameter_distance",
    f"SELECT layer, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: pow(CAST(z[2] AS DOUBLE) - CAST(z[1] AS DOUBLE), 2))) / len(x)), 4) AS rms, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: pow(CAST(z[2] AS DOUBLE) - CAST(z[1] AS DOUBLE), 2))) / nullif(list_sum(list_transform(x, lambda v: pow(CAST(v AS DOUBLE), 2))), 0)), 4) AS relative FROM {_PAIRED} p",
    "embeddings",
)
def _(emb: DataFrame) -> DataFrame:
    d = _sum(F.zip_with("x", "y", lambda a, b: F.pow(b.cast("double") - a.cast("double"), 2)))
    base = _sum(F.transform("x", lambda a: F.pow(a.cast("double"), 2)))
    return _paired(emb).select("layer", F.round(F.sqrt(d / F.size("x")), 4).alias("rms"), F.round(F.sqrt(F.try_divide(d, F.nullif(base, F.lit(0.0)))), 4).alias("relative"))


@_query(
    "js_divergence",
    f"""SELECT layer, round(least(1.0, greatest(0.0, list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * z[1] * log2(2 * z[1] / (z[1] + z[2])) + 0.5 * z[2] * log2(2 * z[2] / (z[1] + z[2])))))), 4) AS bits FROM (
SELECT layer, list_transform(ex, lambda v: v / list_sum(ex)) AS p, list_transform(ey, lambda v: v / list_sum(ey)) AS q FROM (SELECT layer, list_transform(x, lambda v: exp(CAST(v AS DOUBLE))) AS ex, list_transform(y, lambda v: exp(CAST(v AS DOUBLE))) AS ey FROM {_PAIRED} a) b) c""",
    "embeddings",
)
def _(emb: DataFrame) -> DataFrame:
    e = _paired(emb).select("layer", *[F.transform(c, lambda v: F.exp(v.cast("double"))).alias(c) for c in ("x", "y")])
    p = e.withColumns({f"s{c}": _sum(F.col(c)) for c in ("x", "y")}).select("layer", F.transform("x", lambda v: v / F.col("sx")).alias("p"), F.transform("y", lambda v: v / F.col("sy")).alias("q"))
    bits = _sum(F.zip_with("p", "q", lambda a, b: 0.5 * a * F.log2(2 * a / (a + b)) + 0.5 * b * F.log2(2 * b / (a + b))))
    return p.select("layer", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bits)), 4).alias("bits"))


@_query(
    "path_length",
    f"""SELECT label, step, round(d, 4) AS interval, round(sum(d) OVER (PARTITION BY label ORDER BY step), 4) AS path FROM (SELECT label, vec_id AS step, sqrt(list_sum(list_transform(list_zip(prev, embedding), lambda z: pow(CAST(z[2] AS DOUBLE) - CAST(z[1] AS DOUBLE), 2)))) AS d FROM (
SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) a WHERE prev IS NOT NULL) b""",
    "embeddings",
)
def _(emb: DataFrame) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    x = emb.withColumn("prev", F.lag("embedding").over(w)).where("prev is not null")
    d = x.select("label", F.col("vec_id").alias("step"), F.sqrt(_sum(F.zip_with("prev", "embedding", lambda a, b: F.pow(b.cast("double") - a.cast("double"), 2)))).alias("d"))
    return d.select("label", "step", F.round("d", 4).alias("interval"), F.round(F.sum("d").over(Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("path"))


#: losses: chain = label of a vector, draw = its id, columns the first five dimensions, the first of them the query
_LOSSES = "(SELECT CAST(label AS BIGINT) AS chain, vec_id AS draw, CAST(i AS BIGINT) AS col, CAST(embedding[CAST(i AS BIGINT) + 1] AS DOUBLE) AS loss FROM embeddings, range(5) r(i))"


def _losses(emb: DataFrame) -> DataFrame:
    return emb.select(F.col("label").cast("long").alias("chain"), F.col("vec_id").alias("draw"), F.posexplode(F.slice("embedding", 1, 5)).alias("col", "loss")).select("chain", "draw", F.col("col").cast("long").alias("col"), F.col("loss").cast("double").alias("loss"))


_X = f"(SELECT c.chain, c.draw, c.col, c.loss, q.loss AS q, (t.s - c.loss) / (t.n - 1) AS m FROM {_LOSSES} c JOIN {_LOSSES} q ON q.chain = c.chain AND q.draw = c.draw AND q.col = 0 JOIN (SELECT chain, draw, sum(loss) AS s, count(*) AS n FROM {_LOSSES} l WHERE col > 0 GROUP BY 1, 2) t ON t.chain = c.chain AND t.draw = c.draw WHERE c.col > 0)"


@_query(
    "chain_influence",
    f"SELECT col - 1 AS candidate, round(avg(cov), 6) AS cov, round(stddev_samp(cov) / sqrt(count(*)), 6) AS cov_stderr, round(avg(coalesce(corr, 0)), 6) AS corr, round(avg(CASE WHEN mm > 0 THEN cov - qm * cm / mm ELSE cov END), 6) AS partial FROM (SELECT chain, col, covar_pop(q, loss) AS cov, corr(q, loss) AS corr, covar_pop(q, m) AS qm, covar_pop(loss, m) AS cm, var_pop(m) AS mm FROM {_X} x GROUP BY 1, 2) p GROUP BY 1",
    "embeddings",
)
def _(emb: DataFrame) -> DataFrame:
    return _rounded(chains.influence(_losses(emb)), "cov", "cov_stderr", "corr", "partial")


@_query("chain_baseline", f"SELECT round(avg(c), 6) AS baseline FROM (SELECT chain, covar_pop(q, a) AS c FROM (SELECT chain, draw, max(CASE WHEN col = 0 THEN loss END) AS q, avg(CASE WHEN col > 0 THEN loss END) AS a FROM {_LOSSES} l GROUP BY 1, 2) x GROUP BY 1) y", "embeddings")
def _(emb: DataFrame) -> DataFrame:
    return _rounded(chains.baseline(_losses(emb)), "baseline")


@_query(
    "chain_coefficient",
    f"SELECT chain, round(10.0 * (avg(s) - 0.0), 6) AS coefficient, round(avg(CASE WHEN i > n - k THEN s END) - avg(CASE WHEN i <= k THEN s END), 6) AS drift FROM (SELECT *, greatest(1, n // 4) AS k FROM (SELECT chain, draw, s, row_number() OVER (PARTITION BY chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY chain) AS n FROM (SELECT chain, draw, avg(loss) AS s FROM {_LOSSES} l WHERE col > 0 GROUP BY 1, 2) a) b) c GROUP BY 1",
    "embeddings",
)
def _(emb: DataFrame) -> DataFrame:
    return _rounded(chains.learning_coefficient(_losses(emb), 10.0, 0.0), "coefficient", "drift")


@_query("chain_screens", None, "embeddings")
def _(emb: DataFrame) -> DataFrame:
    return _rounded(chains.screens(_losses(emb).withColumn("name", F.concat(F.lit("col_"), F.col("col").cast("string")))), "split_rhat", "batch_ess", "max_time_correlation")


@_query("sampler_draws", None, "events")
def _(events: DataFrame) -> DataFrame:
    return chains.learning_coefficient(chains.sgld(events.sparkSession, 4, 4, 400, 0.02, 10.0, 2.0, 7), 10.0, 0.0)
