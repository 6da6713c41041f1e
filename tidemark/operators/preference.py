"""Preference pairs: where the sides part, whether length or generator decides, and who met whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import half_decade, wilson
from tidemark.operators.fields import branch


def _chars(side: str, after: Column) -> Column:
    lengths = F.transform(F.col(f"{side}.content"), lambda t, i: F.when(i >= after, F.coalesce(F.length(t), F.lit(0))).otherwise(0))
    return F.aggregate(F.coalesce(lengths, F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, n: a + n)


def pair_lengths(dpo: DataFrame, keep: list[str]) -> DataFrame:
    """keep + (shared, shared_whole, chosen_chars, rejected_chars, delta): characters behind the branch of each side.

    shared is capped so that either side keeps its last turn; shared_whole is not, and identical sides are all shared.
    """
    shared = dpo.select(*keep, "chosen", "rejected", branch(dpo.schema).alias("shared"), branch(dpo.schema, capped=False).alias("shared_whole"))
    out = shared.withColumn("chosen_chars", _chars("chosen", F.col("shared"))).withColumn("rejected_chars", _chars("rejected", F.col("shared")))
    return out.withColumn("delta", F.col("chosen_chars") - F.col("rejected_chars")).drop("chosen", "rejected")


def length_rule(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of the pairs whose sides differ in length, the share in which the chosen is longer; ties apart."""
    agg = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") > 0).alias("longer"), F.count_if(F.col("delta") != 0).alias("decided"))
    low, high = wilson(F.col("longer"), F.col("decided"))
    return agg.select(*by, "pairs", "ties", "longer", "decided", F.round(F.try_divide(F.col("longer").cast("double"), F.col("decided").cast("double")), 6).alias("rate"), F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


def breakdown(pairs: DataFrame, columns: list[str], most: int = 40) -> DataFrame:
    """The length rule for each value of each column that has between 2 and ``most`` values, over the decided pairs."""
    long = pairs.where("delta <> 0").select("delta", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "value")).where("value <> ''")
    rates = length_rule(long, ["column", "value"]).drop("ties", "decided")
    fit = rates.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)).select("column")
    return rates.join(F.broadcast(fit.limit(len(columns))), "column", "left_semi")


def matchups(dpo: DataFrame) -> DataFrame:
    """(chosen_model, rejected_model, pairs) of ordered generator pairs; an unknown generator is a null."""
    return dpo.groupBy("chosen_model", "rejected_model").agg(F.count(F.lit(1)).alias("pairs"))


def model_rule(dpo: DataFrame) -> DataFrame:
    """How often the best rule that only reads both generators' names is right, on the rows it is fitted on."""
    m = matchups(dpo)
    known = (F.length("chosen_model") > 0) & (F.length("rejected_model") > 0)
    decided = m.where(known & (F.col("chosen_model") != F.col("rejected_model")))
    best = decided.groupBy(F.least("chosen_model", "rejected_model").alias("a"), F.greatest("chosen_model", "rejected_model").alias("b")).agg(F.max("pairs").alias("k"), F.sum("pairs").alias("n"))
    rule = best.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("right"), F.coalesce(F.sum("n"), F.lit(0)).alias("decided"), F.count(F.lit(1)).alias("matchups"))
    rest = m.agg(F.coalesce(F.sum(F.when(known & (F.col("chosen_model") == F.col("rejected_model")), F.col("pairs"))), F.lit(0)).alias("same_model"), F.coalesce(F.sum(F.when(~F.coalesce(known, F.lit(False)), F.col("pairs"))), F.lit(0)).alias("unknown"))
    return rule.join(rest, how="cross").select("right", "decided", "matchups", "same_model", "unknown", F.round(F.try_divide(F.col("right").cast("double"), F.col("decided").cast("double")), 6).alias("rate"))


def signed_histogram(pairs: DataFrame, value: str) -> DataFrame:
    """(sign, bin, pairs): positive and negated negative values on the logarithmic scale."""
    return pairs.where(F.col(value) != 0).groupBy(F.signum(value).cast("int").alias("sign"), half_decade(F.abs(value)).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


def meta_columns(schema: T.StructType, names: list[str]) -> list[str]:
    return [n for n in names if n in schema.names]
