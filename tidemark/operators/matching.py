"""Joins that tell what they could not join: crosstabs, pairing evidence, lengths by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNMATCHED, UNDECIDABLE = "(unmatched)", "(undecidable)"


def crosstab(labels: DataFrame, groups: DataFrame, key: str, label: str, group: str, top: int = 12) -> DataFrame:
    """(group, label, rows): labels by the group their key has in another table.

    A key that the other table lacks, or that is null, is unmatched; one it holds under several groups is undecidable. Groups
    beyond the ``top`` most frequent (ties by name) are folded into one, named by how many they are. The join is by a key
    that is unique on one side after a partial aggregate; frequencies are counted on the result, one row a group.
    """
    g = groups.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(key).agg(F.min(group).alias("_a"), F.max(group).alias("_b"))
    name = F.when(F.col("_a").isNull(), UNMATCHED).when(F.col("_a") != F.col("_b"), UNDECIDABLE).otherwise(F.col("_a"))
    counts = labels.select(key, F.col(label).alias("label")).join(g, key, "left").groupBy(name.alias("group"), "label").agg(F.count(F.lit(1)).alias("rows"))
    real = ~F.col("group").isin(UNMATCHED, UNDECIDABLE)
    size = counts.where(real).groupBy("group").agg(F.sum("rows").alias("n"))
    ranked = size.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "group")))  # of groups, not of rows
    small = ranked.where(F.col("rank") > top).select("group")
    folded = small.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy()))
    out = counts.join(folded, "group", "left")
    return out.groupBy(F.when(F.col("many").isNotNull(), F.format_string("%d smaller values", F.col("many"))).otherwise(F.col("group")).alias("group"), "label").agg(F.sum("rows").alias("rows"))


def pairing_evidence(a: DataFrame, b: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """One row (matched, only_a, only_b, rate, verdict) on whether two draws may be paired by a key.

    equal: the same keys; joined: at least ``least`` of the keys of either side are shared; else refused. Null keys pair with none.
    """
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    n = x.join(y, key, "full").agg(F.count_if(F.col("_a") & F.col("_b")).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    most = F.col("matched") + F.greatest("only_a", "only_b")
    rate = F.when(most > 0, F.col("matched") / most).otherwise(0.0)
    verdict = F.when((F.col("only_a") + F.col("only_b") == 0) & (F.col("matched") > 0), "equal").when(F.col("rate") >= least, "joined").otherwise("refused")
    return n.withColumn("rate", rate).withColumn("verdict", verdict)


def lengths_by_text(shown: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, joined): the stored length of each shown text, met by the digest of the text, null and false if none is stored.

    stored: (text, chars); of several lengths of one text the greatest counts.
    """
    have = stored.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_sha")).agg(F.max("chars").alias("chars"))
    return shown.select(key, F.sha2(text, 256).alias("_sha")).join(have, "_sha", "left").select(key, "chars", F.col("chars").isNotNull().alias("joined"))
