"""Token budget per source, language and domain (problem 1).

For each language tokens are a linear function of what a text is made of: bytes, words, letters by script, digits,
punctuation. It is fitted by ridge regression on rows tokenized exactly, and its bias is corrected by the ratio of true to
predicted tokens on other tokenized rows (the holdout). As the function is linear, its sum over a group of rows is the
function of the group's feature sums: applying it everywhere is one JVM-side aggregation without any Python.

Scale. One scan, one partial aggregate, a shuffle of group sums. The fit uses about ``FIT_ROWS`` rows and the holdout about
``HOLDOUT_ROWS``, taken at the scan by a cut of the hash of their key; the rows that are counted are all.

Defined results: null and empty contents cost nothing; rows without a language count under ``und``, domains are folded
(case, blanks), a missing domain or source is its own group; negative predictions count as 0 for a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import declared
from tidemark.llm.truncation import hash_sample
from tidemark.llm.vocab_tokens import tokenizer

FIT_ROWS, HOLDOUT_ROWS = 4000, 2000
#: rows of a language in the fit below which the function of all languages together is used
LEAST_ROWS = 40
FEATURES = ["docs", "bytes", "words", "letters", "han", "accented", "digits", "digit_runs", "punct", "long_words"]


def features(text: Column) -> dict[str, Column]:
    """What a text is made of, as JVM expressions."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("double")
    return {
        "docs": F.when(F.length(text) > 0, 1.0).otherwise(0.0),
        "bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("double"),
        "words": count(r"[\p{L}&&[^\p{IsHan}]]+"),
        "letters": count(r"[\p{L}&&[^\p{IsHan}]]"),
        "han": count(r"\p{IsHan}"),
        "accented": count(r"[\p{L}&&[^\p{IsHan}\x00-\x7f]]"),
        "digits": count(r"\p{N}"),
        "digit_runs": count(r"\p{N}+"),
        "punct": count(r"[^\p{L}\p{N}\s]"),
        "long_words": count(r"[\p{L}&&[^\p{IsHan}]]{9,}"),
    }


def slices(sft: DataFrame) -> DataFrame:
    """(row_id, source_dataset, language, domain, text): one row a record, its contents joined; languages as codes."""
    domain = F.lower(F.regexp_replace("domain", r"^\s+|\s+$", ""))
    return sft.select(
        "row_id",
        F.when(F.length("source_dataset") > 0, F.col("source_dataset")).otherwise("(none)").alias("source_dataset"),
        F.coalesce(declared(F.col("language")), F.lit("und")).alias("language"),
        F.when(F.length(domain) > 0, domain).otherwise("(none)").alias("domain"),
        F.array_join("messages.content", "\n").alias("text"),
    )


def _count(batches: Iterator[pa.RecordBatch], tok: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    count = tok.value.count
    for batch in batches:
        n = pa.array([count(t) for t in batch.column(keep).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), n], names=[*batch.schema.names[:keep], "tokens"])


def count_tokens(df: DataFrame, keys: list[str], text: str, vocab: DataFrame) -> DataFrame:
    """The key columns and the exact number of tokens of a text column."""
    tok, keep = tokenizer(vocab), df.select(*keys, text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    n = len(keys)
    return keep.mapInArrow(lambda it: _count(it, tok, n), f"{ddl}, tokens long")


def _per_token(error: np.ndarray, guess: np.ndarray) -> float:
    """Variance of rows' errors for each token."""
    if not len(error):
        return 0.0
    return float(max((error**2 / np.maximum(guess, 1.0)).mean(), (error**2).sum() / max(1.0, guess.sum())))


class TokenModel:
    """Coefficients and bias factor of each language, of all together under '*', with the errors seen on the holdout.

    The error of a slice has three parts: that of the bias factor (``spread``, of the tokens), what slices have in common
    that the function does not see (``tau``, of the tokens) and chance of the rows (variance ``phi`` for each token).
    """

    def __init__(self, rows: list[tuple[str, np.ndarray, int, bool, tuple]]) -> None:
        self.coefficients: dict[str, np.ndarray] = {}
        self.bias: dict[str, float] = {}
        self.spread: dict[str, float] = {}
        self.tau: dict[str, float] = {}
        self.phi: dict[str, float] = {}
        fit = [r for r in rows if not r[3]]
        hold = [r for r in rows if r[3]]
        for lang in ["*", *sorted({r[0] for r in rows})]:
            own = [r for r in fit if lang in ("*", r[0])]
            if lang != "*" and len(own) < LEAST_ROWS:
                continue
            x = np.array([r[1] for r in own]).reshape(len(own), len(FEATURES))
            y = np.array([r[2] for r in own], float)
            weight = 1 / np.sqrt(np.maximum(y, 1.0))  # errors grow as the root of the length
            scale = np.maximum(np.abs(x).max(0, initial=0), 1.0)
            a = (x / scale) * weight[:, None]
            beta = np.linalg.solve(a.T @ a + 1e-4 * np.eye(len(FEATURES)), a.T @ (y * weight)) / scale
            test = [r for r in hold if lang in ("*", r[0])] or own
            truth = sum(r[2] for r in test)
            guess = np.array([max(0.0, float(r[1] @ beta)) for r in test])
            factor = truth / guess.sum() if len(test) and guess.sum() > 0 else 1.0
            guess = factor * guess
            error = np.array([r[2] for r in test]) - guess
            self.coefficients[lang], self.bias[lang] = beta, float(factor)
            self.spread[lang] = float(np.sqrt((error**2).sum()) / max(1, truth)) if len(test) else 0.0
            self.phi[lang] = _per_token(error, guess)
        # a language's few holdout rows can miss what is rare: its chance is at least that of all rows under their own functions
        hold = hold or fit
        guess = np.array([max(0.0, float(r[1] @ self.coefficients[self.of(r[0])])) * self.bias[self.of(r[0])] for r in hold])
        error = np.array([r[2] for r in hold]) - guess
        pooled = _per_token(error, guess)
        groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(hold):
            groups.setdefault((r[0], *r[4]), []).append(i)
        between = 0.0  # of slices, and of all that have a language, source or domain in common: their chance is smaller
        for of in (lambda r: (r[0], *r[4]), lambda r: r[0], lambda r: r[4][:1], lambda r: r[4][1:]):
            alike: dict[object, list[int]] = {}
            for i, r in enumerate(hold):
                alike.setdefault(of(r), []).append(i)
            part = [(len(g), error[g].sum(), max(1.0, guess[g].sum())) for g in alike.values() if len(g) > 1]
            between = max(between, sum(n * max(0.0, e * e - pooled * t) / (t * t) for n, e, t in part) / max(1, sum(n for n, _, _ in part)))
        self.tau = dict.fromkeys(self.coefficients, float(np.sqrt(between)))
        self.phi = {k: max(v, pooled) for k, v in self.phi.items()}
        # languages without a function of their own: what the common one misses of each of them as a whole counts too
        rare: dict[str, list[tuple[float, float]]] = {}
        for r in rows:
            if self.of(r[0]) == "*":
                t = max(0.0, float(r[1] @ self.coefficients["*"])) * self.bias["*"]
                rare.setdefault(r[0], []).append((r[2] - t, t))
        if rare:
            flat = np.array([x for v in rare.values() for x in v])
            self.phi["*"] = max(self.phi["*"], _per_token(flat[:, 0], flat[:, 1]))
            off = [sum(e for e, _ in v) / max(1.0, sum(t for _, t in v)) for v in rare.values()]
            self.tau["*"] = max(self.tau["*"], float(np.sqrt(np.mean(np.square(off)))))
        # errors have longer tails than the normal law: the width that holds 95 % of the holdout's slices, if it is greater
        z = []
        for (lang, *_), g in groups.items():
            k, t = self.of(lang), max(1.0, guess[g].sum())
            z.append(abs(error[g].sum()) / np.sqrt((t * self.spread[k]) ** 2 + (t * self.tau[k]) ** 2 + self.phi[k] * t + 1e-9))
        at = int(np.ceil(0.95 * (len(z) + 1))) - 1
        self.width = float(min(4.0, max(1.96, sorted(z)[at] if 0 <= at < len(z) else 1.96)))

    def of(self, lang: str) -> str:
        return lang if lang in self.coefficients else "*"


def fit_model(sft: DataFrame, vocab: DataFrame) -> TokenModel:
    base = slices(hash_sample(sft, FIT_ROWS + HOLDOUT_ROWS)).withColumn("h", F.xxhash64("row_id", F.lit(1)))
    rows = count_tokens(base.select("row_id", "h", "source_dataset", "language", "domain", *[v.alias(k) for k, v in features(F.col("text")).items()], "text"), ["row_id", "h", "source_dataset", "language", "domain", *FEATURES], "text", vocab).collect()
    rows = sorted(rows, key=lambda r: (r.h, r.row_id is None, r.row_id))
    every = max(2, round((FIT_ROWS + HOLDOUT_ROWS) / HOLDOUT_ROWS))
    return TokenModel([(r.language, np.array([r[f] for f in FEATURES]), r.tokens, i % every == 0, (r.source_dataset, r.domain)) for i, r in enumerate(rows)])


def token_budget(sft: DataFrame, vocab: DataFrame) -> DataFrame:
    """(source_dataset, language, domain, rows, tokens, tokens_low, tokens_high): estimated tokens with 95 % bounds."""
    model = fit_model(sft, vocab)
    cols = slices(sft)
    sums = (
        cols.select("source_dataset", "language", "domain", *[v.alias(k) for k, v in features(F.col("text")).items()])
        .groupBy("source_dataset", "language", "domain")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f).alias(f) for f in FEATURES])
    )

    def pick(values: dict[str, float]) -> Column:
        out = None
        for lang in model.coefficients:
            if lang != "*":
                out = (F.when if out is None else out.when)(F.col("language") == lang, F.lit(float(values[lang])))
        return F.lit(float(values["*"])) if out is None else out.otherwise(F.lit(float(values["*"])))

    linear = sum(F.col(f) * pick({k: b[i] for k, b in model.coefficients.items()}) for i, f in enumerate(FEATURES))
    tokens = F.greatest(F.lit(0.0), linear * pick(model.bias))
    margin = model.width * F.sqrt(F.pow(tokens * pick(model.spread), 2) + F.pow(tokens * pick(model.tau), 2) + tokens * pick(model.phi))
    return sums.select(
        "source_dataset", "language", "domain", "rows",
        F.round(tokens).cast("long").alias("tokens"),
        F.round(F.greatest(F.lit(0.0), tokens - margin)).cast("long").alias("tokens_low"),
        F.round(tokens + margin).cast("long").alias("tokens_high"),
    )


def exact_tokens(sft: DataFrame, vocab: DataFrame) -> DataFrame:
    """(source_dataset, language, domain, rows, tokens), every content tokenized."""
    n = count_tokens(slices(sft).select("source_dataset", "language", "domain", "text"), ["source_dataset", "language", "domain"], "text", vocab)
    return n.groupBy("source_dataset", "language", "domain").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"))
