"""Fold assignment, subsampling, and statistics fitted inside folds.

Shuffles are orders by md5(seed:key): the same on every engine and every rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import places


def shuffled(seed: int, *keys: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def grouped_folds(subjects: DataFrame, subject: str, label: str, k: int, seed: int) -> DataFrame:
    """(subject, label, fold 1..k): subjects shuffled inside their class and dealt in turn. One row a subject."""
    return row_folds(subjects.select(subject, label).distinct(), [subject], label, k, seed)


def row_folds(rows: DataFrame, key: list[str], label: str, k: int, seed: int) -> DataFrame:
    """rows with fold 1..k, dealt row by row inside a class; rows of one subject fall into many folds (leaky)."""
    ranked = places(rows.withColumn("_h", shuffled(seed, *key)), [label], "_h", key)
    return ranked.withColumn("fold", (F.col("place") % k + 1).cast("int")).drop("_h", "place")


def stratified_sample(rows: DataFrame, key: list[str], label: str, most: int, seed: int) -> DataFrame:
    """At most about `most` rows, each class in proportion: round(most * n_class / n)."""
    total = rows.count()
    if total <= most:
        return rows
    quota = rows.groupBy(label).agg(F.floor(F.count("*") * most / F.lit(float(total)) + 0.5).alias("_q"))
    ranked = places(rows.withColumn("_h", shuffled(seed, *key)), [label], "_h", key)
    return ranked.join(F.broadcast(quota), label).filter(F.col("place") < F.col("_q")).drop("_q", "_h", "place")


def validation_split(rows: DataFrame, key: str | list[str], share: float, seed: int, least: int = 2) -> DataFrame:
    """(key, validation): the first max(least, round(share * n)) of the shuffled keys, which name subjects, or single epochs."""
    keys = [key] if isinstance(key, str) else key
    ids = rows.select(*keys).distinct()
    take = max(least, int(share * ids.count() + 0.5))
    placed = places(ids.withColumn("_h", shuffled(seed, *keys)), [], "_h", keys)
    return placed.select(*keys, (F.col("place") < take).alias("validation"))


def training_statistics(long: DataFrame, folds: DataFrame, subject: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(fold, feature, med, mean, sd) of the rows outside each fold; missing values (null or NaN) count as the median in mean and sd.

    A feature without values has median 0; a deviation under 1e-12 counts as 1. Rows aren't copied for each fold: their moments are
    added up by fold, and medians are found by middles.medians(), so no task holds a feature.
    """
    from .middles import medians

    v = F.when(~F.isnan(F.col(value)), F.col(value))
    own = long.join(folds.select(subject, "fold"), subject).select("fold", feature, v.alias("_v"))
    k = folds.select("fold").distinct()
    # a row for each feature and fold; what is outside a fold is put together from the other folds' rows, in which the fold has no part
    parts = own.groupBy(feature, "fold").agg(F.count("_v").alias("n"), (F.count("*") - F.count("_v")).alias("_gone"), F.coalesce(F.avg("_v"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("_v"), F.lit(0.0)).alias("v"))
    others = parts.join(F.broadcast(k.withColumnRenamed("fold", "_f")), F.col("fold") != F.col("_f"))
    rest = others.groupBy(feature, "_f").agg(F.collect_list(F.struct("n", "m", "v")).alias("_p"), F.sum("_gone").alias("_gone")).withColumnRenamed("_f", "fold")
    met = rest.join(medians(own, [feature], "_v", "fold"), ["fold", feature], "left").withColumn("med", F.coalesce("med", F.lit(0.0)))
    # the missing values are one more part: all of them the median
    every = F.concat("_p", F.array(F.struct(F.col("_gone").alias("n"), F.col("med").alias("m"), F.lit(0.0).alias("v"))))
    total = lambda f: F.aggregate(every, F.lit(0.0), lambda s, p: s + p["n"] * f(p))
    n = total(lambda p: F.lit(1.0))
    placed = met.withColumn("_n", n).withColumn("mean", F.try_divide(total(lambda p: p["m"]), F.col("_n"))).filter("_n > 0")
    square = total(lambda p: p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    sd = F.coalesce(F.sqrt(F.try_divide(square, F.col("_n") - 1)), F.lit(0.0))
    return placed.select("fold", feature, "med", "mean", F.when(sd < 1e-12, 1.0).otherwise(sd).alias("sd"))


def scaled(long: DataFrame, statistics: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """long, once for each fold of the statistics, with z: filled by the fold's median and scaled by its mean and sd."""
    z = (F.coalesce(F.when(~F.isnan(F.col(value)), F.col(value)), F.col("med")) - F.col("mean")) / F.col("sd")
    return long.join(statistics, feature).withColumn("z", z).drop("med", "mean", "sd")


def age_residuals(rows: DataFrame, folds: DataFrame, subject: str, age: str, value: str) -> DataFrame:
    """rows (subject, age, value) with fold and residual: the line of value on age is fitted outside the row's fold."""
    own = rows.join(folds.select(subject, "fold"), subject)
    k = folds.select("fold").distinct().withColumnRenamed("fold", "_f")
    lines = own.join(k, F.col("fold") != F.col("_f")).groupBy("_f").agg(F.regr_slope(value, age).alias("_b"), F.regr_intercept(value, age).alias("_a"))
    return own.join(lines, F.col("fold") == F.col("_f")).withColumn("residual", F.col(value) - F.col("_a") - F.col("_b") * F.col(age)).drop("_f", "_a", "_b")


def robust_scaled(long: DataFrame, folds: DataFrame, subject: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """long, once for each fold, with z: the value over the scaled median absolute deviation of the rows outside the fold, 0 where it is missing."""
    from .epochs import MAD_SCALE
    from .middles import medians

    k = folds.select("fold").distinct().withColumnRenamed("fold", "_f")
    own = long.join(folds.select(subject, "fold"), subject).select("fold", feature, F.col(value).alias("_v"))
    med = medians(own, [feature], "_v", "fold").withColumnRenamed("fold", "_f")
    # distances from each fold's median: counted where they are, never gathered
    away = own.join(F.broadcast(k), F.col("fold") != F.col("_f")).join(med, [feature, "_f"]).select(F.col("_f").alias("fold"), feature, F.abs(F.col("_v") - F.col("med")).alias("_d"))
    mad = medians(away, ["fold", feature], "_d").select("fold", feature, (F.col("med") * MAD_SCALE).alias("mad"))
    z = F.coalesce(F.col(value) / F.greatest(F.col("mad"), F.lit(2.220446049250313e-16)), F.lit(0.0))
    return long.join(mad, feature).withColumn("z", z).drop("mad")
