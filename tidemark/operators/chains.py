"""Diagnostics of loss draws: (chain, draw, col, loss), col 0 the query, others the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def influence(losses: DataFrame) -> DataFrame:
    """For each candidate covariance, correlation and partial covariance with the query, within chains, then averaged.

    partial: both series less their projection on the mean of the other candidates of the draw.
    """
    query = losses.where("col = 0").select("chain", "draw", F.col("loss").alias("q"))
    cand = losses.where("col > 0")
    total = cand.groupBy("chain", "draw").agg(F.sum("loss").alias("total"), F.count(F.lit(1)).alias("n"))
    x = cand.join(total, ["chain", "draw"]).join(query, ["chain", "draw"]).withColumn("m", F.when(F.col("n") > 1, (F.col("total") - F.col("loss")) / (F.col("n") - 1)))
    per = x.groupBy("chain", "col").agg(
        F.covar_pop("q", "loss").alias("cov"), F.corr("q", "loss").alias("corr"), F.covar_pop("q", "m").alias("qm"), F.covar_pop("loss", "m").alias("cm"), F.var_pop("m").alias("mm")
    )
    partial = F.when(F.col("mm") > 0, F.col("cov") - F.col("qm") * F.col("cm") / F.col("mm")).otherwise(F.col("cov"))
    out = per.withColumn("partial", partial).groupBy("col").agg(
        F.avg("cov").alias("cov"), F.try_divide(F.stddev_samp("cov"), F.sqrt(F.count(F.lit(1)))).alias("cov_stderr"), F.avg(F.coalesce("corr", F.lit(0.0))).alias("corr"), F.avg("partial").alias("partial")
    )
    return out.select((F.col("col") - 1).alias("candidate"), "cov", "cov_stderr", "corr", "partial")


def baseline(losses: DataFrame) -> DataFrame:
    """The query's covariance with the average candidate loss, within chains, then averaged."""
    q = losses.where("col = 0").select("chain", "draw", F.col("loss").alias("q"))
    m = losses.where("col > 0").groupBy("chain", "draw").agg(F.avg("loss").alias("m"))
    return q.join(m, ["chain", "draw"]).groupBy("chain").agg(F.covar_pop("q", "m").alias("c")).agg(F.avg("c").alias("baseline"))


def learning_coefficient(losses: DataFrame, nbeta: float, origin: float) -> DataFrame:
    """(chain, coefficient, drift): nbeta (E[L] - L(w*)) over the candidates, and last less first quarter of the draws."""
    series = losses.where("col > 0").groupBy("chain", "draw").agg(F.avg("loss").alias("loss"))
    w = Window.partitionBy("chain")
    placed = series.withColumn("i", F.row_number().over(w.orderBy("draw"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("quarter", F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    return placed.groupBy("chain").agg(
        (F.lit(nbeta) * (F.avg("loss") - F.lit(origin))).alias("coefficient"),
        (F.avg(F.when(F.col("i") > F.col("n") - F.col("quarter"), F.col("loss"))) - F.avg(F.when(F.col("i") <= F.col("quarter"), F.col("loss")))).alias("drift"),
    )


def screens(series: DataFrame, value: str = "loss") -> DataFrame:
    """(name, split_rhat, batch_ess, max_time_correlation) of observables (name, chain, draw, value)."""
    w = Window.partitionBy("name", "chain")
    x = series.withColumn("i", (F.row_number().over(w.orderBy("draw")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w)).withColumnRenamed(value, "v")
    half = F.floor(F.col("n") / 2)
    part = F.when(F.col("i") < half, 0).when(F.col("i") >= F.col("n") - half, 1)
    halves = x.withColumn("part", part).where("part is not null").groupBy("name", "chain", "part").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.count(F.lit(1)).alias("h"))
    rhat = halves.groupBy("name").agg(F.avg("s").alias("within"), F.var_samp("m").alias("spread"), F.max("h").alias("h"))
    rhat = rhat.select("name", F.when(F.col("within") > 0, F.sqrt(((F.col("h") - 1) * F.col("within") + F.col("h") * F.col("spread")) / (F.col("h") * F.col("within")))).alias("split_rhat"))
    width = F.greatest(F.lit(2), F.floor(F.sqrt("n")).cast("long"))
    blocks = x.withColumn("width", width).withColumn("block", F.floor(F.col("i") / F.col("width"))).where((F.col("block") + 1) * F.col("width") <= F.col("n"))
    means = blocks.groupBy("name", "chain", "block").agg(F.avg("v").alias("m")).groupBy("name").agg(F.var_samp("m").alias("bv"), F.count(F.lit(1)).alias("bn"))
    flat = x.groupBy("name").agg(F.var_samp("v").alias("fv"), F.count(F.lit(1)).alias("fn"))
    ess = flat.join(means, "name").select("name", F.when(F.col("bv") > 0, F.least(F.col("fn").cast("double"), F.col("fv") / (F.col("bv") / F.col("bn")))).otherwise(0.0).alias("batch_ess"))
    time = x.groupBy("name", "chain").agg(F.abs(F.corr("v", F.col("i").cast("double"))).alias("c")).groupBy("name").agg(F.max(F.coalesce("c", F.lit(1.0))).alias("max_time_correlation"))
    return rhat.join(ess, "name").join(time, "name")


def sgld(spark, dimensions: int, chains: int, draws: int, step: float, nbeta: float, localization: float, seed: int) -> DataFrame:  # noqa: ANN001
    """Langevin chains around 0 of a quadratic loss |w|^2 / 2: (chain, draw, col, loss), one chain a task.

    The posterior is Gaussian with variance 1 / (nbeta + localization) in each direction, which checks the sampler.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        r = np.random.default_rng([seed, chain])
        w = np.zeros(dimensions)
        out = np.empty(draws)
        for k in range(draws + draws // 4):
            w = w - step / 2 * (nbeta + localization) * w + np.sqrt(step) * r.standard_normal(dimensions)
            if k >= draws // 4:
                out[k - draws // 4] = 0.5 * float(w @ w)
        return pd.DataFrame({"chain": chain, "draw": np.arange(draws), "col": 1, "loss": out})

    return spark.range(chains).select(F.col("id").alias("chain")).groupBy("chain").applyInPandas(run, "chain long, draw long, col int, loss double")
