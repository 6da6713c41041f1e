"""Queries of the training-text operators: name -> (spark, data directory) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, leakage, mixing, pairs, pii, shared_spans, token_budget, truncation
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _t(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query over the named tables."""
    return lambda f: lambda spark, d: f(*(table(spark, d, n) for n in names))


def _segments(sft: DataFrame, dpo: DataFrame, rl: DataFrame, samples: DataFrame) -> DataFrame:
    texts = language.user_texts(sft, dpo, rl)
    found = language.label_languages(texts, ["stage", "row_id"], "text", samples)
    return found.select("stage", "row_id", F.explode("segments").alias("s")).select("stage", "row_id", "s.start", "s.stop", "s.lang", "s.confidence", "s.words")


def _text_languages(sft: DataFrame, dpo: DataFrame, rl: DataFrame, samples: DataFrame) -> DataFrame:
    texts = language.user_texts(sft, dpo, rl).withColumn("declared", language.declared(F.col("language")))
    return language.label_languages(texts, ["stage", "row_id", "declared"], "text", samples).select("stage", "row_id", "declared", "lang", "confidence", F.size("segments").alias("segments"))


def _masked(sft: DataFrame, chat: DataFrame, samples: DataFrame) -> DataFrame:
    found = pii.find_pii(pii.turn_texts(sft, chat), ["stage", "row_id"], "turns", samples, with_text=True)
    return found.where(F.size("found") > 0).select("stage", "row_id", F.posexplode("masked").alias("turn", "content"))


def queries() -> dict[str, Query]:
    user = ("sft_rows", "dpo_rows", "rl_rows", "lang_samples")
    cut = ("sft_rows", "dpo_rows")
    return {
        "p1_token_budget": _t("sft_rows", "token_vocab")(token_budget.token_budget),
        "p1_token_exact": _t("sft_rows", "token_vocab")(token_budget.exact_tokens),
        "p2_found": _t(*user)(language.label_cases),
        "p2_text_languages": _t(*user)(_text_languages),
        "p2_segments": _t(*user)(_segments),
        "p3_found": _t(*cut)(lambda s, d: truncation.truncated_turns(s, d).select("stage", "row_id", "side", "turn")),
        "p3_truncation_rates": _t(*cut)(truncation.truncation_rates),
        "p4_found": _t("sft_rows", "chat_rows", "lang_samples")(pii.pii_cases),
        "p4_masked_turns": _t("sft_rows", "chat_rows", "lang_samples")(_masked),
        "p6_found": _t(*cut, "lang_samples")(lambda *x: pairs.defective_answers(*x).select("stage", "row_id", "side", "turn", "defect")),
        "p6_defect_rates": _t(*cut, "lang_samples")(pairs.defect_rates),
        "p7_found": _t("documents", "eval_items")(leakage.leaked_pairs),
        "p7_removal_spans": _t("documents", "eval_items")(leakage.removal_spans),
        "p7_leaks_by_benchmark": _t("documents", "eval_items")(leakage.leaks_by_benchmark),
        "p8_mix_documents": _t("documents", "mix_targets", "token_vocab")(mixing.mix_documents),
        "p8_mix_shares": _t("documents", "mix_targets", "token_vocab")(mixing.mix_shares),
        "p8_source_sizes": _t("documents", "token_vocab")(mixing.source_sizes),
        "p9_found": _t("documents")(shared_spans.shared_pairs),
        "p9_shared_share": _t("documents")(shared_spans.shared_share),
    }


# ---------------------------------------------------------------------------------------------------------------- SQL

#: words of the texts of a relation src(key columns, text) with how often they stand, and the number of pieces of each word
_PIECES = r"""
units AS (
  SELECT k, unnest(regexp_extract_all(regexp_replace(lower(text), '([\x{3400}-\x{9fff}\x{f900}-\x{faff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x0b\x{85}]')) AS w FROM src
),
counted AS (SELECT k, w, count(*) AS n FROM units GROUP BY k, w),
vocab AS (SELECT DISTINCT w FROM counted),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS p FROM vocab),
fits AS (
  SELECT w, p, max(l) AS l FROM (SELECT w, p, unnest(range(1, least(length(w) - p + 1, 40) + 1)) AS l FROM places) x
  JOIN token_vocab t ON t.piece = CASE WHEN p = 1 THEN '' ELSE '##' END || substr(w, p, l) GROUP BY w, p
),
walk AS (
  SELECT w, 1 AS p, 0 AS n FROM vocab
  UNION ALL
  SELECT walk.w, CAST(walk.p + fits.l AS INTEGER), walk.n + 1 FROM walk JOIN fits ON fits.w = walk.w AND fits.p = walk.p
),
sizes AS (SELECT vocab.w, coalesce(max(CASE WHEN walk.p > length(walk.w) THEN walk.n END), 1) AS pieces FROM vocab JOIN walk ON walk.w = vocab.w GROUP BY vocab.w)
"""


def _declared_sql(col: str) -> str:
    base = f"regexp_extract(lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g')), '^([^-_]*)', 1)"
    full = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"
    missing = ", ".join(f"'{m}'" for m in language.MISSING)
    arms = " ".join(f"WHEN {full} IN ({n}) OR {base} IN ({n}) THEN '{code}'" for code, names in language.SPELLINGS.items() for n in [", ".join(f"'{x}'" for x in names)])
    return f"CASE WHEN {col} IS NULL OR {full} IN ({missing}) OR {base} IN ({missing}) THEN NULL {arms} ELSE {full} END"


_PHRASES = r"""
words_of_items AS (
  SELECT item_id, part, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w
  FROM (SELECT item_id, 'question' AS part, question AS body FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items) x WHERE body IS NOT NULL
),
phrases AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM words_of_items) x),
words_of_docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM words_of_docs) x),
leaks AS (SELECT DISTINCT doc_id, item_id FROM grams JOIN phrases USING (p))
"""


def oracle_sql() -> dict[str, str]:
    domain = "lower(regexp_replace(domain, '^\\s+|\\s+$', '', 'g'))"
    return {
        "p1_token_exact": f"""
WITH RECURSIVE base AS (
  SELECT row_id AS k, CASE WHEN length(source_dataset) > 0 THEN source_dataset ELSE '(none)' END AS source_dataset,
    coalesce({_declared_sql("language")}, 'und') AS language, CASE WHEN length({domain}) > 0 THEN {domain} ELSE '(none)' END AS domain,
    array_to_string(list_filter(list_transform(messages, lambda m: m.content), lambda c: c IS NOT NULL), chr(10)) AS text
  FROM sft_rows
),
src AS (SELECT k, coalesce(text, '') AS text FROM base), {_PIECES},
per AS (SELECT k, sum(n * pieces) AS tokens FROM counted JOIN sizes USING (w) GROUP BY k)
SELECT source_dataset, language, domain, count(*) AS rows, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM base LEFT JOIN per USING (k) GROUP BY 1, 2, 3""",
        "p7_found": f"WITH {_PHRASES} SELECT doc_id, item_id FROM leaks",
        "p7_leaks_by_benchmark": f"""
WITH {_PHRASES}
SELECT benchmark, split, count(DISTINCT e.item_id) AS items, count(DISTINCT l.item_id) AS leaked_items, count(DISTINCT l.doc_id) AS documents
FROM eval_items e LEFT JOIN leaks l USING (item_id) GROUP BY 1, 2""",
        "p8_source_sizes": f"""
WITH RECURSIVE src AS (SELECT doc_id AS k, text FROM documents WHERE text IS NOT NULL), {_PIECES},
per AS (SELECT k, sum(n * pieces) AS tokens FROM counted JOIN sizes USING (w) GROUP BY k)
SELECT nullif(trim(source), '') AS source, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM documents JOIN per ON per.k = documents.doc_id GROUP BY 1""",
        "p9_found": r"""
WITH anchors AS (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320),
keys AS (SELECT doc_id, hash(substr(text, i, 320)) AS h FROM anchors)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM keys a JOIN keys b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p9_shared_share": r"""
WITH classes AS (SELECT text, min(doc_id) AS class_id, count(*) AS c FROM documents WHERE length(text) >= 320 GROUP BY text),
w AS (SELECT class_id, i, hash(substr(text, i, 320)) AS h FROM (SELECT class_id, text, unnest(range(1, length(text) - 318)) AS i FROM classes) x),
held AS (SELECT h FROM w GROUP BY h HAVING min(class_id) < max(class_id)),
steps AS (SELECT class_id, i, i - lag(i) OVER (PARTITION BY class_id ORDER BY i) AS d FROM w JOIN held USING (h)),
runs AS (SELECT class_id, i, sum(CASE WHEN d IS NULL OR d > 320 THEN 1 ELSE 0 END) OVER (PARTITION BY class_id ORDER BY i) AS run FROM steps),
spans AS (SELECT class_id, run, max(i) - min(i) + 320 AS n FROM runs GROUP BY 1, 2),
covered AS (SELECT class_id, CAST(sum(n) AS BIGINT) AS chars, count(*) AS spans FROM spans GROUP BY 1),
whole AS (
  SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, length(d.text) AS n_chars, CASE WHEN c.c > 1 THEN 1 ELSE coalesce(v.spans, 0) END AS spans,
    CASE WHEN d.text IS NULL THEN NULL WHEN c.c > 1 THEN length(d.text) ELSE coalesce(v.chars, 0) END AS shared_chars
  FROM documents d LEFT JOIN classes c ON c.text = d.text LEFT JOIN covered v ON v.class_id = c.class_id
)
SELECT doc_id, class_id, n_chars, spans, shared_chars, CASE WHEN n_chars > 0 THEN shared_chars / n_chars END AS shared_share FROM whole""",
    }
