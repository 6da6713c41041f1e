"""Stored records and what may be said over them: cut fields, censored searches, settled items, guarded joins, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson


def context_turns(df: DataFrame, key: str, column: str, limit: int = 4000) -> DataFrame:
    """(key, turn, role, text, chars, sha): turns with text kept to ``limit``; a cut text has a digest of the whole."""
    zipped = F.arrays_zip(F.col(f"{column}.role").alias("role"), F.col(f"{column}.content").alias("content"))
    t = df.select(key, F.posexplode(zipped).alias("turn", "m")).where("m.content is not null")
    cut = F.length("m.content") > limit
    return t.select(key, "turn", F.col("m.role").alias("role"), F.left("m.content", F.lit(limit)).alias("text"), F.length("m.content").alias("chars"), F.when(cut, F.sha2("m.content", 256)).alias("sha"))


def censored_counts(turns: DataFrame, key: str, test: object) -> DataFrame:
    """(records, matched, censored, clear): a record without a match in what is kept, but with a cut field, is censored."""
    per = turns.groupBy(key).agg(F.bool_or(test(F.col("text"))).alias("hit"), F.bool_or(F.col("sha").isNotNull()).alias("cut"))
    hit, cut = F.coalesce("hit", F.lit(False)), F.col("cut")
    return per.agg(F.count(F.lit(1)).alias("records"), F.count_if(hit).alias("matched"), F.count_if(~hit & cut).alias("censored"), F.count_if(~hit & ~cut).alias("clear"))


def settle(items: DataFrame, probes: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, status): present with any hit, absent if all its parts were probed without one, else unresolved."""
    parts = items.select("item_id", (F.col("question").isNotNull().cast("int") + F.col("answer").isNotNull().cast("int")).alias("parts"))
    probed = probes.groupBy("item_id").agg(F.count(F.lit(1)).alias("probed"))
    seen = hits.select("item_id").distinct().withColumn("seen", F.lit(True))
    status = F.when(F.col("seen"), "present").when((F.col("probed") == F.col("parts")) & (F.col("parts") > 0), "absent").otherwise("unresolved")
    return parts.join(probed, "item_id", "left").join(seen, "item_id", "left").select("item_id", status.alias("status"))


def paired(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """(pairs, agree, unpaired) of two label runs: rows that only one labelled are unpaired, never dropped unseen."""
    a, b = first.select(key, F.col(label).alias("a")), second.select(key, F.col(label).alias("b"))
    j = a.join(b, key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count_if(both).alias("pairs"), F.count_if(both & (F.col("a") == F.col("b"))).alias("agree"), F.count_if(~both).alias("unpaired"))


def guarded_join(left: DataFrame, right: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """A left join with its provenance: matched, missing, or stale where both sides were made from different revisions."""
    r = right.withColumnRenamed(revision, "_other").withColumn("_there", F.lit(True))
    status = F.when(F.col("_there").isNull(), "missing").when(~F.col(revision).eqNullSafe(F.col("_other")), "stale").otherwise("matched")
    return left.join(r, key, "left").withColumn("status", status).drop("_other", "_there")


def matching_tokens(rates: DataFrame, size: Column, weighted: Column, matched: Column, rows: Column, keys: list[str]) -> DataFrame:
    """keys + (tokens, tokens_low, tokens_high): a weighted rate times a size, the ends scaled by rate over count rate."""
    lo, hi = wilson(matched, rows)
    plain = F.try_divide(matched.cast("double"), rows.cast("double"))
    scale = F.coalesce(F.try_divide(weighted, plain), F.lit(1.0))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(size.cast("double"), c))
    return rates.select(*keys, F.round(weighted * size, 6).alias("tokens"), F.round(clamp(lo * scale * size), 6).alias("tokens_low"), F.round(clamp(hi * scale * size), 6).alias("tokens_high"))
