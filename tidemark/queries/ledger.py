"""Queries of stages, cells, matching and leakage over training rows, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import cells, contamination, fields, grep, matching, stages
from tidemark.queries.audit import _EMITS, _PAIR, _PROBES, _dpo_hits, _rl_hits, _sft_hits, _src, _wilson
from tidemark.session import table
from tidemark.sources import parquet

Query = Callable[[SparkSession, str], DataFrame]

PATTERN = "bus timetable"
TABLES = ("sft_rows", "dpo_rows", "rl_rows", "chat_rows", "documents", "eval_items")
#: the stages of the test tables, in order; two of them have no run, one of these no table
REGISTRY = [("pretrain", 0, None), ("midtrain", 1, "midtrain_rows"), ("sft", 2, "sft_rows"), ("dpo", 3, "dpo_rows"), ("rlvr", 4, "rl_rows")]
LABELLED = [("pretrain", "pretrain", "documents"), ("sft", "post-training", "sft_rows"), ("dpo", "post-training", "dpo_rows"), ("rlvr", "post-training", "rl_rows"), ("chat", "post-training", "chat_rows")]


def _run(df: DataFrame, stage: str, key: str, produced: list[str], readable: list[str], sides: tuple[str, ...] = fields.SIDES, partial: bool = False) -> DataFrame:
    """The counts of one search over one stage."""
    plan = fields.text_plan(df.schema, sides)
    whole = fields.text_plan(df.schema)
    h = grep.hits(df, key, [], text.literal_test(PATTERN), plan)
    some = lambda names: F.count_if(F.coalesce(F.greatest(*[F.col(n).cast("int") for n in names if n in plan.sides()], F.lit(0), F.lit(0)), F.lit(0)) > 0)
    return h.agg(F.count(F.lit(1)).alias("rows"), F.count_if("any").alias("matched"), some(produced).alias("produced"), some(readable).alias("readable")).select(
        F.lit(stage).alias("stage"), "rows", "matched", "produced", "readable", F.lit(partial).alias("partial"), F.lit(plan.sides()).alias("sides"), F.lit(whole.sides()).alias("available"), F.array().cast("array<string>").alias("unsearched")
    )


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame(REGISTRY, "stage string, place int, dataset string")
    runs = (
        _run(table(spark, d, "sft_rows"), "sft", "row_id", ["response"], ["prompt", "response"])
        .unionByName(_run(table(spark, d, "dpo_rows"), "dpo", "row_id", ["chosen"], ["prompt", "chosen"]))
        .unionByName(_run(table(spark, d, "rl_rows"), "rlvr", "row_id", [], ["prompt"], ("prompt", "reference")))
    )
    v = stages.stage_verdicts(registry, runs)
    return v.withColumns({c: F.round(c, 6) for c in ("rate", "lo", "hi")})


def _drawn(df: DataFrame, stage: str, dataset: str, revision: str, route: str, fit: object, whole: object, hit: object) -> DataFrame:
    return df.select(F.lit(stage).alias("stage"), fit.cast("long").alias("fit_chars"), whole.cast("long").alias("all_chars"), F.coalesce(hit, F.lit(False)).alias("matched"), F.lit(route).alias("route"), F.lit(dataset).alias("ex_dataset"), F.lit(revision).alias("ex_revision"))


def _chars(column: str, kept: object = None) -> object:
    zipped = F.arrays_zip(F.col(f"{column}.role").alias("r"), F.col(f"{column}.content").alias("t"))
    mine = F.filter(zipped, kept) if kept is not None else zipped
    return F.aggregate(F.transform(mine, lambda m: F.length(F.coalesce(m["t"], F.lit(""))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def _budget(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    registry = spark.createDataFrame(LABELLED, "stage string, family string, dataset string")
    fit = lambda m: fields.emits(m["r"])
    has = lambda c: F.exists(F.transform(F.coalesce(F.col(f"{c}.content"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), lambda x: F.contains(F.lower(x), F.lit(PATTERN)))
    n = lambda c: F.nullif(c, F.lit(0).cast("long"))
    examples = (
        _drawn(t("documents"), "pretrain", "documents", "r1", "shards", n(F.length("text").cast("long")), F.length("text"), F.contains(F.lower("text"), F.lit(PATTERN)))
        .unionByName(_drawn(t("sft_rows"), "sft", "sft_rows", "r1", "rows", n(_chars("messages", fit)), _chars("messages"), has("messages")))
        .unionByName(_drawn(t("dpo_rows"), "dpo", "dpo_rows", "r1", "rows", n(_chars("chosen", fit)), _chars("chosen"), has("chosen")))
        .unionByName(_drawn(t("rl_rows"), "rlvr", "rl_rows", "r1", "rollouts", F.aggregate(F.transform("outputs", lambda x: F.length(F.coalesce(x, F.lit(""))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.length("prompt"), F.contains(F.lower("prompt"), F.lit(PATTERN))))
    )
    sizes = None
    for stage, name, revision in (("pretrain", "documents", "r1"), ("sft", "sft_rows", "r1"), ("dpo", "dpo_rows", "r2"), ("rlvr", "rl_rows", "r1"), ("chat", "chat_rows", "r1")):
        one = t(name).agg((F.count(F.lit(1)) * 10).alias("total")).select(F.lit(stage).alias("stage"), "total", F.lit(name).alias("size_dataset"), F.lit(revision).alias("size_revision"), F.lit(False).alias("straddled"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return stages.stage_budget(registry, sizes, examples)


def _rows_hit(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    out = None
    for stage, name in (("sft", "sft_rows"), ("dpo", "dpo_rows"), ("rlvr", "rl_rows")):
        one = contamination.side_hits(table(spark, d, name), "row_id", items).select(F.lit(stage).alias("stage"), "row", "side", "item_id", "part")
        out = one if out is None else out.unionByName(one)
    return out


def _info(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in TABLES:
        df = table(spark, d, name)
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def _fixtures(spark: SparkSession, d: str) -> DataFrame:
    small = cells.fixture_rows(table(spark, d, "chat_rows").select("row_id", "conversation"), chars=200, items=2)
    return small.select("row_id", F.size("conversation").cast("long").alias("turns"), F.get("conversation", 0)["content"].alias("first"))


def _crosstab(spark: SparkSession, d: str) -> DataFrame:
    sft = table(spark, d, "sft_rows")
    return matching.crosstab(sft, sft, "id", "domain", "source_dataset", top=5)


def _longer_side() -> Column:
    chosen, rejected = (F.length(F.element_at(F.filter(F.col(f"{c}.content"), lambda x: x.isNotNull()), -1)) for c in ("chosen", "rejected"))
    return F.when(chosen > rejected, "longer").when(chosen < rejected, "shorter")


def queries() -> dict[str, Query]:
    t = table
    q = lambda c: F.round(c, 6)
    return {
        "contaminate_rows": _rows_hit,
        "contaminate_sides": lambda s, d: _rows_hit(s, d).groupBy("stage", "side", "part").agg(F.countDistinct("row").alias("rows"), F.countDistinct("item_id").alias("items")),
        "contaminate_sets": lambda s, d: contamination.item_sets(_rows_hit(s, d), t(s, d, "eval_items")),
        "stage_verdict": _verdicts,
        "stage_budget": lambda s, d: _budget(s, d).withColumns({c: F.round(c, 6) for c in ("size_tokens", "fit_share", "rate", "tokens", "tokens_low", "tokens_high")}),
        "stage_budget_totals": lambda s, d: stages.budget_totals(_budget(s, d)).withColumns({c: F.round(c, 6) for c in ("size_tokens", "measured_size_tokens", "tokens", "tokens_low", "tokens_high", "share")}),
        "table_info": _info,
        "fixture_rows": _fixtures,
        "cell_texts": lambda s, d: (lambda rl: rl.select("row_id", cells.cell_text(rl, "prompt").alias("prompt"), cells.cell_text(rl, "outputs").alias("outputs"), cells.cell_text(rl, "difficulty").alias("difficulty")))(t(s, d, "rl_rows")),
        "formatted_shares": lambda s, d: (lambda g: g.select("source", cells.percent(F.col("share")).alias("share"), cells.one_in(F.col("share")).alias("odds"), cells.bytes_text(F.col("chars").cast("double") * 1000).alias("bytes")))(
            t(s, d, "documents").groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("(no source value)")).alias("source")).agg((F.count_if(F.contains(F.lower("text"), F.lit(PATTERN))) / F.count(F.lit(1))).alias("share"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
        ),
        "document_dates": lambda s, d: t(s, d, "documents").select("doc_id", cells.iso_utc(F.col("crawled_at")).alias("crawled")),
        "crawl_snapshots": lambda s, d: t(s, d, "documents").groupBy(cells.snapshot(F.col("metadata")).alias("snapshot")).agg(F.count(F.lit(1)).alias("documents")),
        "judge_batches": lambda s, d: cells.batches(parquet.numbered(t(s, d, "documents").select("doc_id"), "doc_id"), "doc_id"),
        "stance_net": lambda s, d: cells.net(t(s, d, "dpo_rows"), F.coalesce(F.nullif("dataset_source", F.lit("")), F.lit("(no source value)")), _longer_side(), "longer", "shorter"),
        "crosstab_joined": _crosstab,
        "pairing_evidence": lambda s, d: matching.pairing_evidence(t(s, d, "sft_rows").where("domain = 'chat'"), t(s, d, "sft_rows"), "id").withColumn("rate", q("rate")),
        "lengths_by_text": lambda s, d: matching.lengths_by_text(t(s, d, "dpo_rows").select("row_id", "prompt"), t(s, d, "dpo_rows").where("id is not null").select("prompt", F.length("prompt").alias("chars")), "row_id", "prompt"),
    }


# ---------------------------------------------------------------------------------------------------------------- SQL


def _sides() -> str:
    side = f"CASE WHEN {_EMITS} THEN '%s' ELSE 'prompt' END"
    return f"""(
SELECT row_id AS row, 'sft' AS stage, {side % 'response'} AS side, m.content AS t FROM (SELECT row_id, unnest(messages) AS m FROM sft_rows) x
UNION ALL SELECT row_id, 'sft', 'prompt', m.functions FROM (SELECT row_id, unnest(messages) AS m FROM sft_rows) x
UNION ALL SELECT row_id, 'sft', 'response', m.function_calls FROM (SELECT row_id, unnest(messages) AS m FROM sft_rows) x
UNION ALL SELECT row_id, 'dpo', 'prompt', prompt FROM dpo_rows
UNION ALL SELECT row_id, 'dpo', 'prompt', m.content FROM (SELECT row_id, unnest(chosen[1:b]) AS m FROM {_PAIR} p) x
UNION ALL SELECT row_id, 'dpo', {side % 'chosen'}, m.content FROM (SELECT row_id, unnest(chosen[b + 1:]) AS m FROM {_PAIR} p) x
UNION ALL SELECT row_id, 'dpo', {side % 'rejected'}, m.content FROM (SELECT row_id, unnest(rejected[b + 1:]) AS m FROM {_PAIR} p) x
UNION ALL SELECT row_id, 'rlvr', 'prompt', prompt FROM rl_rows
UNION ALL SELECT row_id, 'rlvr', 'prompt', m.content FROM (SELECT row_id, unnest(source_prompt) AS m FROM rl_rows) x
UNION ALL SELECT row_id, 'rlvr', 'reference', m FROM (SELECT row_id, unnest(ground_truth) AS m FROM rl_rows) x
UNION ALL SELECT row_id, 'rlvr', 'reference', reward_model.ground_truth FROM rl_rows
UNION ALL SELECT row_id, 'rlvr', 'rollout', m FROM (SELECT row_id, unnest(outputs) AS m FROM rl_rows) x)"""


_ROWS_HIT = f"""(SELECT DISTINCT stage, row, side, item_id, part FROM (SELECT DISTINCT row, stage, side, t FROM {_sides()} s WHERE t IS NOT NULL) d
JOIN (SELECT item_id, part, (CASE WHEN regexp_matches(words[1], '^[0-9a-z_]') THEN '\\b' ELSE '' END) || array_to_string(list_transform(words, lambda x: regexp_escape(x)), '[\\t\\n\\f\\r ]+') || (CASE WHEN regexp_matches(words[-1], '[0-9a-z_]$') THEN '\\b' ELSE '' END) AS rx,
  words[CAST(len(words) / 2 AS BIGINT)] AS mid, words[2] AS second FROM {_PROBES} p) q ON contains(lower(d.t), q.mid) AND contains(lower(d.t), q.second) AND regexp_matches(d.t, q.rx, 'i'))"""


def _verdict_sql() -> str:
    lo, hi = _wilson("n", "rows")
    return f"""WITH runs AS (
  SELECT 'sft' AS stage, count(*) AS rows, count(*) FILTER (WHERE prompt OR response) AS matched, count(*) FILTER (WHERE response) AS produced, count(*) FILTER (WHERE prompt OR response) AS readable, '' AS gaps FROM ({_sft_hits(PATTERN)}) h
  UNION ALL SELECT 'dpo', count(*), count(*) FILTER (WHERE prompt OR chosen OR rejected), count(*) FILTER (WHERE chosen), count(*) FILTER (WHERE prompt OR chosen), '' FROM ({_dpo_hits(PATTERN)}) h
  UNION ALL SELECT 'rlvr', count(*), count(*) FILTER (WHERE prompt OR reference), 0, count(*) FILTER (WHERE prompt), 'not read: rollout' FROM ({_rl_hits(PATTERN)}) h),
r AS (SELECT g.stage, place, dataset, rows, matched, produced, readable, coalesce(gaps, '') AS gaps,
  CASE WHEN rows IS NULL THEN CASE WHEN dataset IS NULL THEN 'unreachable' ELSE 'unsearched' END WHEN matched > 0 THEN 'hits' WHEN gaps = '' THEN 'zero' ELSE 'inconclusive' END AS status
  FROM (VALUES ('pretrain', 0, NULL), ('midtrain', 1, 'midtrain_rows'), ('sft', 2, 'sft_rows'), ('dpo', 3, 'dpo_rows'), ('rlvr', 4, 'rl_rows')) g(stage, place, dataset) LEFT JOIN runs USING (stage)),
b AS (SELECT *, status = 'hits' AND coalesce(readable, 0) = 0 AS blocked, CASE WHEN coalesce(max(CASE WHEN status = 'hits' AND coalesce(readable, 0) > 0 THEN produced END) OVER (), 0) > 0 THEN 'produced' ELSE 'readable' END AS basis FROM r),
c AS (SELECT *, CASE WHEN status = 'hits' AND NOT blocked THEN CASE WHEN basis = 'produced' THEN produced ELSE readable END END AS n FROM b),
e AS (SELECT *, n * 1.0 / rows AS rate, CASE WHEN n IS NOT NULL THEN {lo} END AS lo, CASE WHEN n IS NOT NULL THEN {hi} END AS hi FROM c),
f AS (SELECT *, CASE WHEN rate > 0 THEN row_number() OVER (ORDER BY rate DESC NULLS LAST, place) END AS rank FROM e)
SELECT stage, status, gaps, basis, blocked, round(rate, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(rank AS INTEGER) AS rank, coalesce(rank > 1 AND hi >= max(CASE WHEN rank = 1 THEN lo END) OVER (), false) AS contender, coalesce(status = 'hits' AND gaps <> '', false) AS understated FROM f"""


def _budget_sql() -> str:
    lo, hi = _wilson("hit", "fitted")
    chars = lambda c, cond: f"coalesce(list_sum(list_transform(list_filter({c}, lambda m: {cond}), lambda m: length(coalesce(m.content, '')))), 0)"
    has = lambda c: f"len(list_filter({c}, lambda m: contains(lower(coalesce(m.content, '')), '{PATTERN}'))) > 0"
    return f"""SELECT stage, family, unsized, total AS rows, size AS size_tokens, CASE WHEN whole > 0 THEN fit / whole END AS fit_share, rate, rate * size AS tokens,
  CASE WHEN rate IS NOT NULL THEN least(greatest(lo * scale * size, 0.0), size) END AS tokens_low, CASE WHEN rate IS NOT NULL THEN least(greatest(hi * scale * size, 0.0), size) END AS tokens_high, coalesce(route = 'rollouts', false) AS floor FROM (
SELECT *, CASE WHEN plain > 0 THEN rate / plain ELSE 1.0 END AS scale FROM (
SELECT *, CASE WHEN fitted > 0 THEN hit * 1.0 / fitted END AS plain, CASE WHEN fit > 0 THEN CASE WHEN route = 'shards' THEN hit * 1.0 / fitted ELSE coalesce(fit_matched, 0) / fit END END AS rate, {lo} AS lo, {hi} AS hi,
  CASE WHEN unsized IS NULL THEN total * fit / fitted / 4.0 END AS size FROM (
SELECT g.stage, family, CASE WHEN e.stage IS NULL THEN 'no examples' WHEN g.stage = 'dpo' THEN 'row count of another revision' WHEN fitted = 0 THEN 'no fitted text' END AS unsized, total, examples, fitted, fit, whole, fit_matched, hit, route
FROM (VALUES ('pretrain', 'pretrain'), ('sft', 'post-training'), ('dpo', 'post-training'), ('rlvr', 'post-training'), ('chat', 'post-training')) g(stage, family)
LEFT JOIN (SELECT stage, count(*) AS examples, count(f) AS fitted, CAST(sum(f) AS DOUBLE) AS fit, CAST(sum(w) AS DOUBLE) AS whole, CAST(sum(f) FILTER (WHERE h) AS DOUBLE) AS fit_matched, count(*) FILTER (WHERE h AND f IS NOT NULL) AS hit, min(route) AS route FROM (
  SELECT 'pretrain' AS stage, nullif(length(text), 0) AS f, length(text) AS w, contains(lower(text), '{PATTERN}') AS h, 'shards' AS route FROM documents
  UNION ALL SELECT 'sft', nullif({chars("messages", _EMITS)}, 0), {chars("messages", "true")}, {has("messages")}, 'rows' FROM sft_rows
  UNION ALL SELECT 'dpo', nullif({chars("chosen", _EMITS)}, 0), {chars("chosen", "true")}, {has("chosen")}, 'rows' FROM dpo_rows
  UNION ALL SELECT 'rlvr', CASE WHEN outputs IS NULL THEN NULL ELSE coalesce(list_sum(list_transform(outputs, lambda x: length(coalesce(x, '')))), 0) END, length(prompt), contains(lower(prompt), '{PATTERN}'), 'rollouts' FROM rl_rows) x GROUP BY stage) e ON e.stage = g.stage
LEFT JOIN (SELECT 'pretrain' AS stage, count(*) * 10 AS total FROM documents UNION ALL SELECT 'sft', count(*) * 10 FROM sft_rows UNION ALL SELECT 'dpo', count(*) * 10 FROM dpo_rows UNION ALL SELECT 'rlvr', count(*) * 10 FROM rl_rows UNION ALL SELECT 'chat', count(*) * 10 FROM chat_rows) s ON s.stage = g.stage) a) b) c"""


def oracle_sql() -> dict[str, str]:
    rounded = lambda sql, cols, rest: f"SELECT {rest}, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM ({sql}) z"
    sets = ", ".join(f"count(*) FILTER (WHERE {n}) AS {n}" for n in ("any_seen", *contamination.ITEM_SETS))
    flags = ", ".join(f"bool_or(part = '{p}' AND side IN ({', '.join(repr(x) for x in s)})) AS {n}" for n, (p, s) in contamination.ITEM_SETS.items())
    last = lambda c: f"length(list_filter(list_transform({c}, lambda m: m.content), lambda x: x IS NOT NULL)[-1])"
    return {
        "contaminate_rows": f"SELECT stage, row, side, item_id, part FROM {_ROWS_HIT} h",
        "contaminate_sides": f"SELECT stage, side, part, count(DISTINCT row) AS rows, count(DISTINCT item_id) AS items FROM {_ROWS_HIT} h GROUP BY 1, 2, 3",
        "contaminate_sets": f"SELECT benchmark, count(*) AS items, {sets} FROM eval_items LEFT JOIN (SELECT item_id, true AS any_seen, {flags} FROM {_ROWS_HIT} h GROUP BY 1) s USING (item_id) GROUP BY 1",
        "stage_verdict": _verdict_sql(),
        "stage_budget": rounded(_budget_sql(), ("size_tokens", "fit_share", "rate", "tokens", "tokens_low", "tokens_high"), "stage, family, unsized, rows, floor"),
        "stage_budget_totals": f"""SELECT coalesce(family, 'all') AS family, count(*) AS stages, round(coalesce(sum(size_tokens), 0), 6) AS size_tokens, round(coalesce(sum(size_tokens) FILTER (WHERE tokens IS NOT NULL), 0), 6) AS measured_size_tokens, round(coalesce(sum(tokens), 0), 6) AS tokens,
round(coalesce(sum(tokens_low), 0), 6) AS tokens_low, round(coalesce(sum(tokens_high), 0), 6) AS tokens_high, coalesce(string_agg(CASE WHEN size_tokens IS NULL THEN stage END, ', ' ORDER BY stage), '') AS unsized, coalesce(string_agg(CASE WHEN floor AND tokens IS NOT NULL THEN stage END, ', ' ORDER BY stage), '') AS floors,
round(CASE WHEN sum(size_tokens) > 0 THEN coalesce(sum(tokens), 0) / sum(size_tokens) ELSE 0 END, 6) AS share FROM ({_budget_sql()}) z GROUP BY ROLLUP (family)""",
        "table_info": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {n}) c) AS columns FROM {n}" for n in TABLES),
        "fixture_rows": "SELECT row_id, CASE WHEN conversation IS NULL THEN -1 ELSE len(conversation[1:2]) END AS turns, left(conversation[1].content, 200) AS first FROM chat_rows",
        "cell_texts": "SELECT row_id, coalesce(prompt, '') AS prompt, coalesce(array_to_string(list_filter(outputs, lambda x: x IS NOT NULL), chr(10)), '') AS outputs, coalesce(CAST(difficulty AS VARCHAR), '') AS difficulty FROM rl_rows",
        "formatted_shares": f"""SELECT source, CASE WHEN share <= 0 THEN '0%' WHEN share * 100 >= 10 THEN printf('%.0f%%', share * 100) WHEN share * 100 >= 1 THEN printf('%.1f%%', share * 100) WHEN share * 100 >= 0.1 THEN printf('%.2f%%', share * 100) WHEN share * 100 >= 0.01 THEN printf('%.3f%%', share * 100) ELSE printf('%.4f%%', share * 100) END AS share,
CASE WHEN share > 0 THEN '1 in ' || format('{{:,}}', CAST(round(1 / share) AS BIGINT)) ELSE '' END AS odds, CASE WHEN chars * 1000 >= 1000000000 THEN printf('%.2f GB', chars * 1000 / 1000000000) ELSE printf('%.0f MB', chars * 1000 / 1000000) END AS bytes FROM (
SELECT {_src('source')} AS source, count(*) FILTER (WHERE contains(lower(text), '{PATTERN}')) * 1.0 / count(*) AS share, CAST(coalesce(sum(n_chars), 0) AS DOUBLE) AS chars FROM documents GROUP BY 1) x""",
        "document_dates": "SELECT doc_id, strftime(crawled_at, '%Y-%m-%dT%H:%M:%SZ') AS crawled FROM documents",
        "crawl_snapshots": """SELECT nullif(CASE WHEN regexp_extract(metadata, '"(?:cc_)?dump": ?"([^"]+)"', 1) <> '' THEN regexp_extract(metadata, '"(?:cc_)?dump": ?"([^"]+)"', 1) ELSE regexp_extract(metadata, '"(?:cc_segment|segment|provenance)": ?"(?:[^"]*[/ ])?(CC-MAIN-[^/ "]+)', 1) END, '') AS snapshot, count(*) AS documents FROM documents GROUP BY 1""",
        "judge_batches": "SELECT doc_id, CAST(floor(n / 20) AS BIGINT) AS batch, n % 20 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) x",
        "stance_net": f"""SELECT "group", count(*) FILTER (WHERE c > r) AS toward, count(*) FILTER (WHERE c < r) AS away, count(*) FILTER (WHERE c > r) - count(*) FILTER (WHERE c < r) AS net FROM (SELECT {_src('dataset_source')} AS "group", {last('chosen')} AS c, {last('rejected')} AS r FROM dpo_rows) x GROUP BY 1""",
        "crosstab_joined": """WITH g AS (SELECT id, min(source_dataset) AS a, max(source_dataset) AS b FROM sft_rows WHERE id IS NOT NULL AND source_dataset IS NOT NULL GROUP BY 1),
c AS (SELECT CASE WHEN a IS NULL THEN '(unmatched)' WHEN a <> b THEN '(undecidable)' ELSE a END AS grp, domain AS label, count(*) AS rows FROM sft_rows LEFT JOIN g USING (id) GROUP BY 1, 2),
s AS (SELECT grp, row_number() OVER (ORDER BY sum(rows) DESC, grp) AS rank FROM c WHERE grp NOT IN ('(unmatched)', '(undecidable)') GROUP BY 1),
f AS (SELECT grp, count(*) OVER () AS many FROM s WHERE rank > 5)
SELECT CASE WHEN many IS NOT NULL THEN many || ' smaller values' ELSE c.grp END AS "group", label, CAST(sum(rows) AS BIGINT) AS rows FROM c LEFT JOIN f ON f.grp = c.grp GROUP BY 1, 2""",
        "pairing_evidence": """SELECT matched, only_a, only_b, round(CASE WHEN matched + greatest(only_a, only_b) > 0 THEN matched * 1.0 / (matched + greatest(only_a, only_b)) ELSE 0 END, 6) AS rate,
CASE WHEN only_a + only_b = 0 AND matched > 0 THEN 'equal' WHEN matched * 1.0 / (matched + greatest(only_a, only_b)) >= 0.9 THEN 'joined' ELSE 'refused' END AS verdict FROM (
SELECT count(*) FILTER (WHERE a AND b) AS matched, count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b FROM (SELECT DISTINCT id, true AS a FROM sft_rows WHERE domain = 'chat' AND id IS NOT NULL) x FULL JOIN (SELECT DISTINCT id, true AS b FROM sft_rows WHERE id IS NOT NULL) y USING (id)) z""",
        "lengths_by_text": "SELECT row_id, chars, chars IS NOT NULL AS joined FROM dpo_rows LEFT JOIN (SELECT prompt, max(length(prompt)) AS chars FROM dpo_rows WHERE prompt IS NOT NULL AND id IS NOT NULL GROUP BY 1) s USING (prompt)",
    }
