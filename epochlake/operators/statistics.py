"""Group statistics from moments: one pass, combined on the map side."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import joins, ranks


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def _tails():
    @F.pandas_udf(DoubleType())
    def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
        """Two-sided p of Student's t; one value for each tested group, so a short series."""
        return pd.Series([None if t_ != t_ or d != d else beta_fraction(d / 2, 0.5, d / (d + t_ * t_)) for t_, d in zip(t, df, strict=True)], dtype="float64")

    @F.pandas_udf(DoubleType())
    def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else beta_fraction(b / 2, a / 2, b / (b + a * v)) for v, a, b in zip(f, d1, d2, strict=True)], dtype="float64")

    return t_tail, f_tail


def two_groups(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """(keys, n1, n0, m1, m0, v1, v0): counts, means and variances of the classes 1 and 0."""
    one = lambda c: F.when(F.col(label) == c, F.col(value))
    return rows.groupBy(*keys).agg(*[x for c in (1, 0) for x in (F.count(one(c)).alias(f"n{c}"), F.avg(one(c)).alias(f"m{c}"), F.var_samp(one(c)).alias(f"v{c}"))])


def pooled_t(moments: DataFrame) -> DataFrame:
    """moments with t of the pooled two-sample test; undefined is 0."""
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0"))))
    return moments.withColumn("t", F.when((F.col("n1") > 1) & (F.col("n0") > 1), F.coalesce(t, F.lit(0.0))).otherwise(0.0))


def welch(moments: DataFrame, least: int = 3) -> DataFrame:
    """moments with t and df of Welch's test; null under `least` values in a class."""
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    enough = (F.col("n1") >= least) & (F.col("n0") >= least)
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return moments.withColumn("t", F.when(enough, t)).withColumn("df", F.when(enough, df))


def with_p(tests: DataFrame, t: str = "t", df: str = "df") -> DataFrame:
    return tests.withColumn("p", _tails()[0](F.col(t), F.col(df)))


def correlation_p(rows: DataFrame, r: str, n: str) -> DataFrame:
    """rows with the two-sided p of a correlation r of n pairs; null where n < 3 or |r| = 1."""
    df = F.col(n) - 2
    t = F.try_divide(F.col(r) * F.sqrt(df.cast("double")), F.sqrt(1 - F.col(r) * F.col(r)))
    return with_p(rows.withColumn("_t", F.when(df > 0, t)).withColumn("_df", df.cast("double")), "_t", "_df").drop("_t", "_df")


def cohen_d(moments: DataFrame) -> DataFrame:
    """moments with d over the root of the average variance."""
    return moments.withColumn("d", F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)))


def anova(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, k, n, f): one-way analysis of variance over the groups of a key."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("_v"))
    s = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("_s"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_q"), F.sum((F.col("_n") - 1) * F.col("_v")).alias("_w"))
    between = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("k") - 1)
    return s.withColumn("f", F.try_divide(between, F.col("_w") / (F.col("n") - F.col("k")))).drop("_s", "_q", "_w")


def anova_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", _tails()[1](F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def benjamini_hochberg(tests: DataFrame, key: str, p: str = "p", q: float = 0.05) -> DataFrame:
    """tests with rank and selected: up to the largest rank k with p(k) <= k / m * q. Ranks are taken in slices of p."""
    ranked = joins.numbered(tests, [p, key]).withColumn("rank", F.col("row").cast("int")).drop("row")
    m = tests.agg(F.count("*").alias("_m"))
    last = ranked.crossJoin(F.broadcast(m)).agg(F.max(F.when(F.col(p) <= F.col("rank") / F.col("_m") * q, F.col("rank"))).alias("_last"))
    return ranked.crossJoin(F.broadcast(last)).withColumn("selected", F.col("rank") <= F.coalesce("_last", F.lit(0))).drop("_last")


def top_features(tests: DataFrame, feature: str, k: int, t: str = "t") -> DataFrame:
    """tests with rank: the k largest |t|, ties to the lower feature. Only k rows meet in the window."""
    order = [F.abs(t).desc(), F.col(feature)]
    return tests.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """(keys, percent, value): linear interpolation between knots at (i - 0.5) / n, ends held.

    Rows are first counted by value, so places are running sums over distinct values, in slices of them.
    """
    v = F.col(value).cast("double")
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    placed = ranks.before(ranks.by_value(counted, F.col("_v")), keys, ["_v"], {"_below": "_c"})
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    asked = placed.join(totals, keys).withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    at = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.col("percent") / 100 * F.col("_n") + 0.5))
    # a value stands at the places below + 1 .. below + count; the knots on both sides of `at` weigh 1 - distance
    first, last = F.floor(at), F.ceil(at)
    has = lambda i: (i > F.col("_below")) & (i <= F.col("_below") + F.col("_c"))
    weight = F.when(has(first), 1 - (at - first)).otherwise(0.0) + F.when((last > first) & has(last), at - first).otherwise(0.0)
    near = asked.withColumn("_w", weight).filter("_w > 0")
    return near.groupBy(*keys, "percent").agg(F.sum(F.col("_v") * F.col("_w")).alias("value"))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, width: float, bins: int) -> DataFrame:
    """(keys, bin, n): half-open bins from low on; the last one is closed; values outside are left out."""
    at = F.when(F.col(value) == low + width * bins, bins - 1).otherwise(F.floor((F.col(value) - low) / width))
    return rows.withColumn("bin", at.cast("int")).filter(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def covariance(samples: DataFrame, keys: list[str], channel: str, at: str, value: str) -> DataFrame:
    """(keys, c1, c2, cov): upper triangle of the channel covariance of each epoch, from a join on (keys, sample)."""
    other = samples.select(*keys, F.col(at).alias(at), F.col(channel).alias("c2"), F.col(value).alias("_w"))
    both = samples.withColumnRenamed(channel, "c1").join(other, [*keys, at]).filter("c1 <= c2")
    return both.groupBy(*keys, "c1", "c2").agg(F.covar_samp(value, "_w").alias("cov"))
