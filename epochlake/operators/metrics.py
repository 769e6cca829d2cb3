"""Votes and scores of predictions (y, yhat, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def vote(predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, y, yhat, score): the majority label; a tie goes to the mean score, against the threshold."""
    share = F.avg(F.col("yhat").cast("double"))
    by = predictions.groupBy(*keys).agg(F.first("y").alias("y"), share.alias("_p"), F.avg("score").alias("score"))
    label = F.when(F.col("_p") == 0.5, F.col("score") > threshold).otherwise(F.col("_p") > 0.5)
    return by.select(*keys, "y", label.cast("int").alias("yhat"), "score")


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, tn, fp, fn, acc, sen, spe, bal, ppv, f1, mcc) in percent but for mcc; empty denominators count as 1, mcc is then 0."""
    y, h = F.col("y") == 1, F.col("yhat") == 1
    n = predictions.groupBy(*keys).agg(F.count_if(y & h).alias("tp"), F.count_if(~y & ~h).alias("tn"), F.count_if(~y & h).alias("fp"), F.count_if(y & ~h).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    sen, spe, ppv = over(tp, tp + fn), over(tn, tn + fp), over(tp, tp + fp)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return n.select(
        "*", (100 * over(tp + tn, tp + tn + fp + fn)).alias("acc"), (100 * sen).alias("sen"), (100 * spe).alias("spe"), (50 * (sen + spe)).alias("bal"),
        (100 * ppv).alias("ppv"), (100 * over(2 * tp, 2 * tp + fp + fn)).alias("f1"), F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0).alias("mcc"),
    )


def auc(rows: DataFrame, keys: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """(keys, auc): area under the ROC curve; null if a class is absent.

    Rows are first counted by score, so the running sum goes over distinct scores, in slices of them.
    """
    by_score = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n"))
    below = ranks.before(ranks.by_value(by_score, F.col(score)), keys, [score], {"_below": "_n"})
    wins = below.withColumn("_w", F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return wins.groupBy(*keys).agg(F.try_divide(F.sum("_w"), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc"))


def mean_sd(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, name, name_sd ...) over repeats; the deviation of one repeat is 0."""
    return metrics.groupBy(*keys).agg(*[x for c in names for x in (F.avg(c).alias(c), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd"))])


def permutation_p(null: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, p): (1 + number of null values >= observed) / (n + 1)."""
    held = null.join(observed.withColumnRenamed(value, "_o"), keys)
    return held.groupBy(*keys).agg(((1 + F.count_if(F.col(value) >= F.col("_o"))) / (F.count("*") + 1)).alias("p"))
