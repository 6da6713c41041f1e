"""Exact scans: how many rows hold a string, on which side, in which source, out of how many.

One aggregation gives numerators and denominators. Rows count once, however often they say it; once for each side that
says it. The row test works on arrays in place, so nothing is shuffled but source sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson
from tidemark.functions.text import snippet
from tidemark.operators.fields import SIDES, Plan, field_rows, source_label, text_plan

Test = Callable[[Column], Column]


def hits(df: DataFrame, key: str, sources: list[str], test: Test, plan: Plan | None = None) -> DataFrame:
    """(row, source, one flag a side, any): every row is kept, so denominators stay."""
    plan = plan or text_plan(df.schema)
    # a flag must not have its side's name while the column of that name is still read
    flags = [F.exists(plan.texts(s), lambda t: F.coalesce(test(t), F.lit(False))).alias(f"hit_{s}") for s in plan.sides()]
    out = df.select(F.col(key).alias("row"), source_label(df, sources).alias("source"), *flags).select("row", "source", *[F.col(f"hit_{s}").alias(s) for s in plan.sides()])
    anyone = F.lit(False)
    for s in plan.sides():
        anyone = anyone | F.col(s)
    return out.withColumn("any", anyone)


def totals(hit: DataFrame, rollup: bool = False) -> DataFrame:
    """For each source: rows, rows matched, matched on each side, rate with Wilson bounds; rollup adds a row over all."""
    sides = [s for s in SIDES if s in hit.columns]
    grouped = hit.rollup("source") if rollup else hit.groupBy("source")
    out = grouped.agg(F.count(F.lit(1)).alias("rows"), F.count_if("any").alias("matched"), *[F.count_if(s).alias(s) for s in sides])
    low, high = wilson(F.col("matched"), F.col("rows"))
    return out.select("source", "rows", "matched", *sides, F.try_divide(F.col("matched").cast("double"), F.col("rows").cast("double")).alias("rate"), low.alias("lo"), high.alias("hi"))


def examples(df: DataFrame, key: str, sources: list[str], pattern: str, test: Test, k: int = 5) -> DataFrame:
    """For each side k distinct snippets, those least by digest: the same whatever the order of arrival."""
    found = field_rows(df, key, sources).where(test(F.col("text"))).select("side", "row", snippet(F.col("text"), pattern).alias("snippet"))
    one = found.groupBy("side", "snippet").agg(F.min("row").alias("row")).withColumn("digest", F.md5("snippet"))
    w = Window.partitionBy("side").orderBy("digest", "snippet")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("side", "rank", "row", "snippet")
