"""Mixing sources to target weights (problem 8): Pareto order sampling.

Sizes are tokens; the total is that of all documents. Of each source the target is its share of the total. Whole copies
come first: as many of every document as fit, at most ``max_repeats``. For the rest documents get inclusion
probabilities in proportion to a weight (the quality in their metadata), one at most, so scaled that the expected size is
what remains; they are ranked by U/(1-U) over p/(1-p), U a hash of the id, and the least are taken until the size is met.

Scale. Texts are read once, for their sizes; all else works on (id, source, tokens, weight), checkpointed. The scaling
needs only sums by source and weight step. The cut in the ranking is found in a histogram of the ranks and then in one of
the bin that holds it; only the part of that bin that holds it, 1 / 262144 of a factor e of the ranks, is put in order,
so a source that holds a third of all rows is never sorted in one task.

Defined results: documents without tokens or without a source are never chosen; a source of no documents reaches 0; where
``max_repeats`` whole copies do not reach the target the shortfall is reported and not given to other sources; ties in
rank go to the lower id; a repeated id counts as often as it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.token_budget import count_tokens
from tidemark.session import ensure_checkpoint_dir

#: weight of a document whose metadata give none, steps of weights, bins of the ranking for each factor e
NO_QUALITY, STEPS, BINS = 0.5, 1000, 64
#: parts of the bin of the cut
FINE = 4096


def quality(metadata: Column) -> Column:
    """The quality stated in the metadata, within [0.001, 1] in steps of a thousandth."""
    q = F.try_to_number(F.regexp_extract(metadata, r'"quality"\s*:\s*([0-9]+\.[0-9]{1,6})', 1).substr(1, 8), F.lit("9.999999")).cast("double")
    return F.coalesce(F.greatest(F.least(F.round(q, 3), F.lit(1.0)), F.lit(1 / STEPS)), F.lit(NO_QUALITY))


def sized(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, weight) of documents with at least one token."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif(F.trim("source"), F.lit("")).alias("source"), quality(F.col("metadata")).alias("weight"), "text")
    return count_tokens(keyed, ["doc_id", "source", "weight"], "text", vocab).where("tokens > 0")


def _uniform(seed: int) -> Column:
    """A number in (0, 1) from the id."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _scale(steps: list[tuple[float, int]], need: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = need, for (weight, tokens) in steps."""
    steps = sorted(steps, reverse=True)
    certain, rest = 0.0, sum(w * t for w, t in steps)
    for w, t in steps:
        c = (need - certain) / rest if rest > 0 else math.inf
        if c * w <= 1:
            return c
        certain += t
        rest -= w * t
    return math.inf


def _plan(sizes: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """For each target source its size, whole copies, remainder and scale; the targets are a small stated table."""
    goal = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").orderBy("source").collect()]
    named = targets.select(F.col("source").alias("t")).where("t is not null").distinct()
    total = sizes.agg(F.sum("tokens").alias("n")).first().n or 0
    steps: dict[str, list[tuple[float, int, int]]] = {}
    by = sizes.join(named, sizes["source"] == named["t"], "left_semi").groupBy("source", "weight").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    for r in by.collect():  # at most STEPS rows for each stated source
        steps.setdefault(r.source, []).append((r.weight, r.tokens, r.docs))
    for g in goal:
        mine = steps.get(g["source"], [])
        have = sum(t for _, t, _ in mine)
        want = g["target_share"] * total
        whole = min(g["max_repeats"] or 0, int(want // have)) if have else 0
        rest = want - whole * have if have and whole < (g["max_repeats"] or 0) else 0.0
        g |= {"docs": sum(d for *_, d in mine), "have": have, "want": want, "whole": whole, "rest": rest, "scale": _scale([(w, t) for w, t, _ in mine], rest) if rest > 0 else 0.0}
    return goal, total


def select_mix(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, list[dict], int]:
    """(doc_id, source, tokens, copies) of the chosen documents; the plan; the total."""
    spark = sizes.sparkSession
    goal, total = _plan(sizes, targets)
    plan = spark.createDataFrame([(g["source"], g["whole"], float(g["rest"]), float(g["scale"])) for g in goal if g["source"] is not None], "source string, whole int, rest double, scale double")
    p = F.least(F.lit(1.0), F.col("scale") * F.col("weight"))
    u = _uniform(seed)
    # the certain come first of all, in the order of U
    rank = F.when(p >= 1, -1000.0 + u).when(p > 0, F.log(u / (1 - u)) - F.log(p / (1 - p)))
    ranked = sizes.join(F.broadcast(plan), "source").withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    bins = ranked.where("rest > 0 and bin is not null").groupBy("source", "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min_by("bin", "bin").alias("cut_bin"), F.min_by(F.col("upto") - F.col("tokens"), "bin").alias("before"))
    placed = ranked.join(cut, "source", "left").withColumn("fine", F.when(F.col("bin") == F.col("cut_bin"), F.floor((F.col("rank") * BINS - F.col("bin")) * FINE).cast("int")))
    # the bin of the cut is split once more, so that the part put in order stays small however large the source
    parts = placed.where("fine is not null").groupBy("source", "fine", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("fine"))
    last = parts.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min("fine").alias("cut_fine"), F.min_by(F.col("upto") - F.col("tokens"), "fine").alias("before_fine"))
    placed = placed.join(last, "source", "left")
    edge = placed.where("fine = cut_fine")
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the line is taken if that comes nearer
    edge = edge.withColumn("extra", (F.col("before_fine") + run - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    whole = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | (F.col("fine") < F.col("cut_fine"))
    sure = placed.where("fine is null or cut_fine is null or fine <> cut_fine").withColumn("extra", F.coalesce((F.col("rest") > 0) & F.col("bin").isNotNull() & whole, F.lit(False)).cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    return sure.select(*cols).unionByName(edge.select(*cols)).where("copies > 0"), goal, total


def mix_documents(docs: DataFrame, targets: DataFrame, vocab: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) of the chosen documents."""
    ensure_checkpoint_dir(docs.sparkSession)
    return select_mix(sized(docs, vocab).checkpoint(), targets, seed)[0]


def mix_shares(docs: DataFrame, targets: DataFrame, vocab: DataFrame, seed: int = 17) -> DataFrame:
    """For each source of the targets what it has, should give and gives, and the shares reached."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    chosen, goal, total = select_mix(sized(docs, vocab).checkpoint(), targets, seed)
    schema = "source string, target_share double, max_repeats int, documents long, tokens_available long, tokens_target double"
    plan = spark.createDataFrame([(g["source"], g["target_share"], g["max_repeats"], g["docs"], int(g["have"]), float(g["want"])) for g in goal], schema)
    got = chosen.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.count(F.lit(1)).alias("d"), F.max("copies").alias("m"))
    reached = F.coalesce("t", F.lit(0)).cast("long")
    out = plan.join(got, plan["source"] == got["s"], "left").select(
        "source", "target_share", "max_repeats", "documents", "tokens_available", F.round("tokens_target").cast("long").alias("tokens_target"),
        reached.alias("tokens_reached"), F.coalesce("d", F.lit(0)).cast("long").alias("documents_chosen"), F.coalesce("m", F.lit(0)).cast("int").alias("most_copies"),
    )
    return out.withColumn("share_of_total", F.try_divide(F.col("tokens_reached").cast("double"), F.lit(float(total)))).withColumn(
        "share_of_mix", F.try_divide(F.col("tokens_reached").cast("double"), F.sum("tokens_reached").over(Window.partitionBy()).cast("double"))
    )


def source_sizes(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(source, documents, tokens) of every source; a missing one is null."""
    return sized(docs, vocab).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
