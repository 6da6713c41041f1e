"""What a pipeline's stages say together: verdicts of one search over all stages, and budgets of matching tokens.

Inputs are small tables, one row a stage (registry, runs, sizes), and the examples drawn of each stage. Nothing but counts
of a stage is joined, so every join here is of a few rows; examples are reduced to one row a stage before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson

HITS, ZERO, UNSEARCHED, UNREACHABLE, INCONCLUSIVE = "hits", "zero", "unsearched", "unreachable", "inconclusive"
CHARS_PER_TOKEN = 4.0


def zero_gaps(partial: Column, read: Column, available: Column, unsearched: Column) -> Column:
    """Why a zero of a run is no zero of its stage: an array of reasons, empty if it is one.

    read and available are arrays of sides, unsearched an array of columns; a run that does not tell what was available
    has shown nothing. Nulls count as empty arrays and as a whole read.
    """
    none = F.array().cast("array<string>")
    read, available, unsearched = (F.coalesce(c, none) for c in (read, available, unsearched))
    left = F.array_sort(F.array_except(available, read))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(partial, F.lit(False)), F.lit("only part of the table was there")),
            F.when(F.size(available) == 0, F.lit("the sides there are were not recorded")).when(F.size(left) > 0, F.concat(F.lit("not read: "), F.array_join(left, ", "))),
            F.when(F.size(unsearched) > 0, F.concat(F.lit("not searched: "), F.array_join(F.array_sort(unsearched), ", "))),
        )
    )


def stage_verdicts(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each stage of a registry (stage, place, dataset): its verdict on a search, and its rank among the hits.

    runs: (stage, rows, matched, produced, readable, partial, sides, available, unsearched), at most one row a stage.
    produced counts rows that match where the model is fit to write, readable those that match where it reads or writes.
    A stage without a run is unsearched, or unreachable if it has no dataset; without a match it is zero only if nothing
    went unread, else inconclusive. Stages rank by their produced rate if any has one, else by their readable rate; a stage
    all of whose matches are ones the model never reads is blocked. A contender's upper bound reaches the leader's lower
    bound; a stage with gaps is understated.
    """
    r = registry.join(runs, "stage", "left")
    gaps = F.when(F.col("rows").isNotNull(), zero_gaps(F.col("partial"), F.col("sides"), F.col("available"), F.col("unsearched")))
    status = (
        F.when(F.col("rows").isNull(), F.when(F.col("dataset").isNull(), UNREACHABLE).otherwise(UNSEARCHED))
        .when(F.col("matched") > 0, HITS)
        .when(F.size("gaps") == 0, ZERO)
        .otherwise(INCONCLUSIVE)
    )
    r = r.withColumn("gaps", gaps).withColumn("status", status)
    hit = F.col("status") == HITS
    r = r.withColumn("blocked", hit & (F.coalesce("readable", F.lit(0)) == 0))
    ranked = hit & ~F.col("blocked")
    every = Window.partitionBy()  # one row a stage
    produced_basis = F.coalesce(F.max(F.when(ranked, F.col("produced"))).over(every), F.lit(0)) > 0
    r = r.withColumn("basis", F.when(produced_basis, "produced").otherwise("readable"))
    count = F.when(F.col("basis") == "produced", F.col("produced")).otherwise(F.col("readable"))
    r = r.withColumn("on", F.when(ranked & (F.col("rows") > 0), count))
    low, high = wilson(F.col("on"), F.col("rows"))
    r = r.withColumn("rate", F.col("on") / F.col("rows")).withColumn("lo", F.when(F.col("on").isNotNull(), low)).withColumn("hi", F.when(F.col("on").isNotNull(), high))
    order = Window.orderBy(F.desc_nulls_last("rate"), "place")
    r = r.withColumn("n", F.row_number().over(order)).withColumn("rank", F.when(F.col("rate") > 0, F.col("n")))
    lead = F.max(F.when(F.col("rank") == 1, F.col("lo"))).over(every)
    return r.select(
        "stage", "status", F.array_join(F.coalesce("gaps", F.array().cast("array<string>")), "; ").alias("gaps"), "basis", "blocked", "rate", "lo", "hi", "rank",
        F.coalesce((F.col("rank") > 1) & (F.col("hi") >= lead), F.lit(False)).alias("contender"),
        (hit & (F.size("gaps") > 0)).alias("understated"),
    )


def stage_budget(registry: DataFrame, sizes: DataFrame, examples: DataFrame) -> DataFrame:
    """One row for each stage (stage, family, dataset): its size in fitted tokens and how many of them match.

    sizes: (stage, total, size_dataset, size_revision, straddled); examples: (stage, fit_chars, all_chars, matched, route,
    ex_dataset, ex_revision), of any number. A stage is sized by its rows times the mean fitted characters of its examples,
    unless the reason says why not. By route ``shards`` the rate is that of documents, else that of fitted characters;
    the bounds are those of the count rate scaled by it, within the stage.
    """
    fit = F.col("fit_chars")
    e = examples.groupBy("stage").agg(
        F.count(F.lit(1)).alias("examples"), F.count(fit).alias("fitted"), F.sum(fit).alias("fit"), F.sum("all_chars").alias("whole"), F.sum(F.when(F.col("matched"), fit)).alias("fit_matched"),
        F.count_if(F.col("matched") & fit.isNotNull()).alias("hit"), F.min("route").alias("route"), F.min("ex_dataset").alias("ex_dataset"), F.min("ex_revision").alias("ex_revision"), F.countDistinct("ex_revision").alias("revisions"),
    )
    r = registry.join(e, "stage", "left").join(sizes, "stage", "left")
    reason = (
        F.when(F.col("examples").isNull(), "no examples")
        .when(F.col("ex_dataset") != F.col("dataset"), "examples of another dataset")
        .when(F.col("revisions") > 1, "examples of several revisions")
        .when(F.col("total").isNull(), "no row count")
        .when(F.coalesce("straddled", F.lit(False)), "row count of several revisions")
        .when((F.col("size_revision") != F.col("ex_revision")) | (F.col("size_dataset") != F.col("dataset")), "row count of another revision")
        .when(F.col("fitted") == 0, "no fitted text")
    )
    r = r.withColumn("unsized", reason)
    size = F.when(F.col("unsized").isNull(), F.col("total") * F.col("fit") / F.col("fitted") / CHARS_PER_TOKEN)
    plain = F.col("hit") / F.col("fitted")
    weighted = F.when(F.col("route") == "shards", plain).otherwise(F.coalesce("fit_matched", F.lit(0)) / F.col("fit"))
    r = r.withColumn("size", size).withColumn("plain", F.when(F.col("fitted") > 0, plain)).withColumn("rate", F.when(F.col("fit") > 0, weighted))
    low, high = wilson(F.col("hit"), F.col("fitted"))
    scale = F.when(F.col("plain") > 0, F.col("rate") / F.col("plain")).otherwise(1.0)
    within = lambda c: F.when(F.col("rate").isNotNull(), F.least(F.greatest(c * scale * F.col("size"), F.lit(0.0)), F.col("size")))
    return r.select(
        "stage", "family", "unsized", F.col("total").alias("rows"), F.col("size").alias("size_tokens"), F.when(F.col("whole") > 0, F.col("fit") / F.col("whole")).alias("fit_share"),
        "rate", (F.col("rate") * F.col("size")).alias("tokens"), within(low).alias("tokens_low"), within(high).alias("tokens_high"), F.coalesce(F.col("route") == "rollouts", F.lit(False)).alias("floor"),
    )


def budget_totals(budget: DataFrame) -> DataFrame:
    """Sums of a `stage_budget` for each family and for all: the share is of what is sized; what is not is listed."""
    named = budget.withColumn("priced", F.when(F.col("tokens").isNotNull(), F.col("size_tokens")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("stage")))), ", ")
    t = named.rollup("family").agg(
        F.count(F.lit(1)).alias("stages"), F.coalesce(F.sum("size_tokens"), F.lit(0.0)).alias("size_tokens"), F.coalesce(F.sum("priced"), F.lit(0.0)).alias("measured_size_tokens"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"),
        F.coalesce(F.sum("tokens_low"), F.lit(0.0)).alias("tokens_low"), F.coalesce(F.sum("tokens_high"), F.lit(0.0)).alias("tokens_high"), listed(F.col("size_tokens").isNull()).alias("unsized"), listed(F.coalesce(F.col("floor"), F.lit(False)) & F.col("tokens").isNotNull()).alias("floors"),
    )
    share = F.when(F.col("size_tokens") > 0, F.col("tokens") / F.col("size_tokens")).otherwise(0.0)
    return t.withColumn("family", F.coalesce("family", F.lit("all"))).withColumn("share", share)


def topological(needs: dict[str, list[str]]) -> list[str]:
    """The steps of a job in an order in which each comes after what it needs, ties by name; a circle is refused."""
    left = {k: set(v) for k, v in needs.items()}
    for v in list(left.values()):
        for x in v:
            left.setdefault(x, set())
    out: list[str] = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"steps that need each other: {', '.join(sorted(left))}")
        out += ready
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return out
