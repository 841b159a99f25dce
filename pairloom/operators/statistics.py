"""Significance and agreement over per-query values, as aggregates and rank windows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def mean_ranks(df: DataFrame, col: str, name: str) -> DataFrame:
    """The rows with the mean rank of ties, from 1. Rows are counted by value first, then values in two levels, ranges of values and
    values of a range, so that no window sees more than the ranges or a range's values."""
    counts = df.groupBy(col).agg(F.count("*").alias("__n"))
    ends = counts.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"), F.count("*").alias("n")).first()
    if not ends.n:
        return df.withColumn(name, F.lit(None).cast("double"))
    width = (ends.hi - ends.lo) / max(1.0, math.sqrt(ends.n)) or 1.0
    counts = counts.withColumn("__range", F.floor((F.col(col).cast("double") - ends.lo) / width))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.groupBy("__range").agg(F.sum("__n").alias("__all")).select("__range", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__ahead"))
    inner = W.partitionBy("__range").orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(ahead, "__range")
    ranks = ranks.select(F.col(col).alias("__value"), (F.col("__ahead") + F.col("__in") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(col) == F.col("__value")).drop("__value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho over all rows in which both are there."""
    some = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    return mean_ranks(mean_ranks(some, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def paired_t(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean_diff, t of paired values."""
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd")).select(
        *by, "n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0).alias("t")
    )


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """n (differences other than 0), w_plus, w_minus, w (the smaller)."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("abs", F.round(F.abs("d"), 9))
    r = mean_ranks(d, "abs", "r")
    s = r.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    return s.withColumn("w", F.least("w_plus", "w_minus"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def udf(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([_beta_tail(n / 2, 0.5, n / (n + x * x)) if n > 0 else 1.0 for x, n in zip(ts, dfs, strict=True)])

    return udf(t, df)


def wilcoxon_p_value(w: Column, n: Column) -> Column:
    """Two-tailed, normal approximation."""
    mean, sd = n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = F.abs((w - mean) / sd)

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda x: math.erfc(x / math.sqrt(2)))

    return tail(z)


def holm(tests: DataFrame, alpha: float = 0.05, step_down: bool = True) -> DataFrame:
    """tests (name, p) with place, bar and significant: bars alpha / (m - place), strictly below. With step-down, nothing
    behind the first failure is significant; without, each test stands alone."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p", "name")) - 1
    t = tests.withColumn("place", place).withColumn("m", F.count("*").over(W.partitionBy(F.lit(0))))
    t = t.withColumn("bar", F.lit(alpha) / (F.col("m") - F.col("place"))).withColumn("below", F.col("p") < F.col("bar"))
    all_before = F.min(F.col("below").cast("int")).over(W.partitionBy(F.lit(0)).orderBy("place").rowsBetween(W.unboundedPreceding, 0)) == 1
    return t.withColumn("significant", all_before if step_down else F.col("below")).drop("below", "m")


def bootstrap_ci(values: DataFrame, by: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """by, mean, low, high: percentiles 2.5 and 97.5 of resampled means, with a seeded generator for each group. Groups are
    one value per query, which fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].to_numpy())
        rng = np.random.RandomState(seed)
        means = [rng.choice(v, len(v), replace=True).mean() for _ in range(resamples)]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [v.mean()], "low": [np.percentile(means, 2.5)], "high": [np.percentile(means, 97.5)]})

    kind = dict(values.dtypes)[by]
    return values.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double")


#: How often a value is drawn when as many are drawn as there are: Poisson with mean 1, by 32 bits of a hash below these bounds.
DRAWS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def draws(unit: Column, resample: Column) -> Column:
    """How often a resample draws a unit: fixed by the two alone, wherever the row lies."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", unit.cast("string"), resample.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [(u >= bound).cast("int") for bound in DRAWS])


def resampled_ci(values: DataFrame, by: str, unit: str, value: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """by, mean, low, high: the interval of resampled means, for groups of any size. Weights come from a hash of unit and number of the
    resample, so tasks add up weighted sums of what they hold, and only one row for each resample leaves them. Nulls are left out; a
    resample that draws nothing has no mean."""
    v = values.select(by, unit, value).filter(F.col(value).isNotNull()).withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    v = v.withColumn("__n", draws(F.col(unit), F.col("__r"))).filter("__n > 0")
    means = v.groupBy(by, "__r").agg((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("__m"))
    ends = means.groupBy(by).agg(*[F.percentile("__m", F.lit(p)).alias(n) for n, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])
    return values.groupBy(by).agg(F.avg(value).alias("mean")).join(ends, by, "left")


def folds(ids: DataFrame, permutation: list, k: int = 5) -> DataFrame:
    """ids with the fold of their place in a permutation, the first folds one longer where k does not divide."""
    spark, n = ids.sparkSession, len(permutation)
    cut = [list(x) for x in np.array_split(np.arange(n), k)]
    rows = [(permutation[i], f) for f, part in enumerate(cut) for i in part]
    return ids.join(F.broadcast(spark.createDataFrame(rows, f"{ids.columns[0]} {ids.dtypes[0][1]}, fold int")), ids.columns[0])


def best_alpha(scores: DataFrame) -> DataFrame:
    """fold, alpha with the largest training mean of (fold, alpha, value); ties to the smaller alpha."""
    m = scores.groupBy("fold", "alpha").agg(F.round(F.avg("value"), 9).alias("value"))
    return m.groupBy("fold").agg(F.max_by("alpha", F.struct("value", -F.col("alpha"))).alias("alpha"), F.max("value").alias("value"))


def invariance(pairs: DataFrame, before: str, after: str, eps: float = 1e-6) -> DataFrame:
    """mean and largest absolute change, and the share of unchanged rows."""
    d = F.abs(F.col(after) - F.col(before))
    return pairs.agg(F.avg(d).alias("mean_change"), F.max(d).alias("max_change"), F.avg((d < eps).cast("double")).alias("unchanged"))


