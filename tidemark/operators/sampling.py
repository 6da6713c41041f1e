"""Deterministic draws: by hash, by page, in proportion to size, stratified over steps, evenly over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int) -> Column:
    """A digest that orders rows at random but always alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows least by digest of their key."""
    return df.withColumn("_k", order_key(F.col(key), seed)).orderBy("_k", key).limit(n).drop("_k")


def page_sample(df: DataFrame, index: str, pages: int, seed: int, size: int = 10) -> DataFrame:
    """Whole pages of ``size`` neighbouring rows, the pages least by digest; with the page of each row."""
    paged = df.withColumn("page", F.floor(F.col(index) / size).cast("long"))
    drawn = paged.select("page").distinct().withColumn("_k", order_key(F.col("page"), seed)).orderBy("_k", "page").limit(pages).drop("_k")
    return paged.join(drawn, "page", "left_semi")


def pps_sample(groups: DataFrame, key: str, size: str, draws: int, seed: int) -> DataFrame:
    """``draws`` groups with replacement in proportion to size: (draw, key), by cumulative size and a hashed point."""
    spark = groups.sparkSession
    span = groups.withColumn("hi", F.sum(size).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col(size))
    total = groups.agg(F.sum(size).alias("total"))
    at = spark.range(draws).select(F.col("id").alias("draw"), F.conv(F.left(order_key(F.col("id"), seed), F.lit(12)), 16, 10).cast("long").alias("h"))
    points = at.join(total, how="cross").withColumn("at", F.pmod(F.col("h"), F.col("total")))
    return points.join(span, (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("draw", key)


def stratified_steps(df: DataFrame, step: str, total: int, slices: int, seed: int) -> DataFrame:
    """One step of each of equal slices [i total / n, (i + 1) total / n), by hash."""
    spark = df.sparkSession
    s = spark.range(slices).select(F.col("id").alias("slice"), F.floor(F.col("id") * total / slices).cast("long").alias("lo"), F.floor((F.col("id") + 1) * total / slices).cast("long").alias("hi"))
    h = F.conv(F.left(order_key(F.col("slice"), seed), F.lit(12)), 16, 10).cast("long")
    return s.where("hi > lo").select("slice", (F.col("lo") + F.pmod(h, F.col("hi") - F.col("lo"))).alias(step))


def even_picks(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows evenly spaced over the order: those with number i n div k, by counts of range partitions.

    Row numbers come from the counts before each group of the leading order column, not from one sort of all rows.
    """
    lead = order[0]
    counts = df.groupBy(lead).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(lead).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    total = counts.agg(F.sum("n").alias("total"))
    placed = df.join(before, lead).withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy(lead).orderBy(*order[1:])) - 1)
    picks = df.sparkSession.range(k).join(total, how="cross").select(F.floor(F.col("id") * F.col("total") / k).cast("long").alias("rn")).distinct()
    return placed.join(picks, "rn", "left_semi").drop("before")


def row_clusters(df: DataFrame, row: str, group: list[str], gap: int = 10) -> DataFrame:
    """Clusters of neighbouring rows of each group: a new one where a row is ``gap`` or more after the one before."""
    w = Window.partitionBy(*group).orderBy(row)
    new = F.when(F.col(row) - F.lag(row).over(w) >= gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")
