"""Statistics as column expressions: intervals, design effects, agreement, histograms, bounds of unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n (effective counts may be fractions); (0, 0) for n <= 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    denominator = 1 + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (2 * n)) / denominator
    half = F.lit(z) * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + F.lit(z * z) / (4 * n * n))) / denominator
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), center - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), center + half)).otherwise(0.0)


def cluster_effective_n(clusters: Column, n: Column, k: Column, squares: Column) -> Column:
    """Effective sample size of a clustered rate.

    squares is the sum over clusters of (y - p m)^2. With fewer than two clusters or a unanimous outcome the design effect
    cannot be estimated, and every cluster counts once.
    """
    c, m = clusters.cast("double"), n.cast("double")
    p = F.try_divide(k.cast("double"), m)
    clustered = F.try_divide(c * squares, (c - 1) * m * m)
    binomial = F.try_divide(p * (1 - p), m)
    effect = F.greatest(F.lit(1.0), F.try_divide(clustered, binomial))
    return F.when((c < 2) | (p == 0) | (p == 1), c).otherwise(F.greatest(F.lit(1.0), m / effect))


def half_decade(value: Column, low: float = 1.0, width: float = 0.5, bins: int = 11) -> Column:
    """Bin of a length on a logarithmic scale from 10, half a decade each; ends are clamped, values <= 0 have none."""
    bin_ = F.floor((F.log10(value.cast("double")) - low) / width).cast("int")
    return F.when(value > 0, F.least(F.greatest(bin_, F.lit(0)), F.lit(bins - 1)))


def union_bounds(matched: Column, elsewhere: Column, groups: list[Column]) -> tuple[Column, Column]:
    """Bounds on the rows in at least one of overlapping groups, from per-group counts and rows matched at all."""
    high = F.least(matched, sum(groups[1:], groups[0]))
    low = F.least(F.greatest(*(groups if len(groups) > 1 else [groups[0], F.lit(0)]), matched - elsewhere), high)
    return low, high


def kappa(both: Column, n: Column, expected: Column) -> Column:
    """Cohen's kappa from agreements, pairs and the sum of products of marginals; null for n = 0 or expectation 1."""
    observed = F.try_divide(both.cast("double"), n.cast("double"))
    chance = F.try_divide(expected.cast("double"), (n * n).cast("double"))
    return F.when(chance < 1, F.try_divide(observed - chance, 1 - chance))


#: Two-sided 95 % quantiles of Student's t by degrees of freedom; beyond the last the normal quantile.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042, 60: 2.0, 120: 1.98}


def t95(df: Column) -> Column:
    """Quantile of the largest tabulated degrees of freedom not above df (conservative), 1.96 beyond the table."""
    steps = sorted(T95.items())
    out = F.when(df < 1, F.lit(None).cast("double"))
    for (_, q), (nxt, _) in zip(steps, steps[1:]):
        out = out.when(df < nxt, q)
    return out.when(df == steps[-1][0], steps[-1][1]).otherwise(Z)
