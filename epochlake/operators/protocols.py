"""Evaluation protocols that differ in what the selection of features may see, transfer between cohorts, feature
subsets, group experiments, and inner grid search. Tables are long: (keys, fold, subject, epoch, y, feature, value).
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlake.sources.stores import held

from . import folds, learn, metrics, ranks, statistics


def subject_ranks(long: DataFrame, keys: list[str], holdout: bool = True) -> DataFrame:
    """(keys, fold, feature, t, rank): features by |t| of the subjects' means over the rows outside each fold, ties to the lower name.

    Without holdout the means are of all rows, so the ranks of every fold have seen its test rows. A subject's mean outside
    a fold is its total less the fold's part, so nothing is copied but a row for each subject, feature and fold.
    """
    parts = long.filter(F.col("value").isNotNull()).groupBy(*keys, "fold", "subject", "y", "feature").agg(F.sum("value").alias("_s"), F.count("*").alias("_n"))
    totals = parts.groupBy(*keys, "subject", "y", "feature").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    each = totals.join(parts.select(*keys, "fold").distinct(), keys).join(parts.drop("y"), [*keys, "fold", "subject", "feature"], "left")
    out = (lambda c: F.coalesce(F.col(c), F.lit(0))) if holdout else lambda c: F.lit(0)
    n = F.col("_tn") - out("_n")
    means = each.filter(n > 0).select(*keys, "fold", "subject", "y", "feature", ((F.col("_ts") - out("_s")) / n).alias("value"))
    tests = statistics.pooled_t(statistics.two_groups(means, [*keys, "fold", "feature"], "y", "value"))
    # sums in another order may differ in the last bit, which must not decide between equal features
    order = Window.partitionBy(*keys, "fold").orderBy(F.round(F.abs("t"), 9).desc(), "feature")
    return tests.select(*keys, "fold", "feature", "t").withColumn("rank", F.row_number().over(order))


def selected_predictions(long: DataFrame, keys: list[str], k: int, holdout: bool = True) -> DataFrame:
    """(keys, subject, epoch, y, yhat, score) of nearest centroids on the k first features of subject_ranks()."""
    chosen = subject_ranks(long, keys, holdout).filter(F.col("rank") <= k).select(*keys, "fold", "feature")
    models = learn.centroid_models(long, keys).join(chosen, [*keys, "fold", "feature"], "left_semi")
    return learn.centroid_predictions(long, models, [*keys, "subject", "epoch", "y"], [*keys, "fold"])


def over_subsets(long: DataFrame, subsets: DataFrame) -> DataFrame:
    """long once for each subset (subset, feature) that names its feature: all subsets are evaluated in one job. A short table."""
    return long.join(F.broadcast(subsets.dropDuplicates()), "feature")


def columns_of(rows: DataFrame, names: list[str], wanted: list[str]) -> DataFrame:
    """rows with features, an array in the order of names, cut to the wanted ones."""
    return rows.withColumn("features", F.array(*[F.get("features", F.lit(names.index(n))) for n in wanted]))


def over_columns(rows: DataFrame, names: list[str], subsets: dict[str, list[str]], predict) -> DataFrame:
    """Predictions of each subset (subset, ...) by a function of rows whose features are the subset's."""
    return reduce(DataFrame.unionByName, [predict(columns_of(rows, names, wanted)).withColumn("subset", F.lit(s)) for s, wanted in subsets.items()])


def nested_forest(rows: DataFrame, long: DataFrame, names: list[str], grid: list[int], inner: int = 3, most: int = 6000, seed: int = 11, threads: int = 4, name: str = "forest", **params) -> DataFrame:
    """(subject, epoch, y, fold, yhat, score): for each fold the k best features by |t| of the training subjects' means, with the k of the grid that
    inner folds of these subjects choose for learner `name`; in the inner folds the features are ranked anew.

    rows: (subject, epoch, y, fold, features in the order of names); long: the same values in rows (subject, epoch, y, fold, feature, value).
    The inner search sees at most `most` rows of a training part, each class in proportion; the last fit sees all of them.
    """
    rows = held(rows)
    dealt = held(inner_folds(rows.select("subject", "y", "fold"), inner, seed))
    # the order of features for each fold, and for each inner fold of it: a row for each of them
    first = {r["fold"]: r["order"] for r in _orders(subject_ranks(long.withColumn("_all", F.lit(0)), ["_all"]), ["fold"]).collect()}
    inside = held(long.drop("fold").join(dealt, "subject").withColumnRenamed("inner", "fold"))
    second = {(r["outer"], r["fold"]): r["order"] for r in _orders(subject_ranks(inside, ["outer"]), ["outer", "fold"]).collect()}
    keep = ["subject", "epoch"]

    def predicted(o):
        training = rows.filter(F.col("fold") != o)
        few = folds.stratified_sample(training, keep, "y", most, seed).drop("fold").join(dealt.filter(F.col("outer") == o), "subject")
        few = held(few.withColumnRenamed("inner", "fold"))
        tried = []
        for i in range(1, inner + 1):
            for k in grid:
                part = columns_of(few, names, second[o, i][:k])
                tried.append(learn.fold_predictions(part, "fold", i, keep, name, **params).withColumn("parameter", F.lit(k)))
        every = reduce(DataFrame.unionByName, tried)
        k = best_of(metrics.confusion(every, ["parameter"]).withColumn("fold", F.lit(o)), ["fold"], grid).first()["parameter"]
        return learn.fold_predictions(columns_of(rows, names, first[o][:k]), "fold", o, keep, name, **params)

    with ThreadPool(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(predicted, sorted(first)))


def _orders(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, order): names of features by rank."""
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias("order"))


def transfer(long: DataFrame, cohort: str, k: int | None = None, own_scale: bool = False) -> DataFrame:
    """(train, test, subject, epoch, y, yhat, score): scaling, the k best features and class centres of each cohort, applied to the others.

    With own_scale a test cohort is scaled by its own mean and deviation, which need no labels.
    """
    keyed = long.withColumn("fold", F.lit(1))
    models = learn.centroid_models(keyed, [cohort], holdout=False)
    if k is not None:
        chosen = subject_ranks(keyed, [cohort], holdout=False).filter(F.col("rank") <= k).select(cohort, "fold", "feature")
        models = models.join(chosen, [cohort, "fold", "feature"], "left_semi")
    models = models.drop("fold").withColumnRenamed(cohort, "train")
    on: list[str] = []
    if own_scale:
        sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
        own = long.groupBy(cohort, "feature").agg(F.avg("value").alias("mean"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("sd"))
        models, on = models.drop("mean", "sd").join(own, "feature"), [cohort]
    p = learn.centroid_predictions(long, models, ["train", cohort, "subject", "epoch", "y"], on)
    return p.filter(F.col("train") != F.col(cohort)).withColumnRenamed(cohort, "test")


def experiments(subjects: DataFrame, pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """subjects (subject, group, ...) once for each experiment whose pairs (experiment, group, y) name the group, with y and fold.

    Folds are dealt anew in each experiment, inside its classes, in slices of the shuffled order.
    """
    own = subjects.join(F.broadcast(pairs), "group")
    placed = ranks.places(own.withColumn("_h", folds.shuffled(seed, "experiment", "subject")), ["experiment", "y"], "_h", ["subject"])
    return placed.withColumn("fold", (F.col("place") % k + 1).cast("int")).drop("_h", "place")


def inner_folds(rows: DataFrame, inner: int = 3, seed: int = 11) -> DataFrame:
    """(outer, subject, inner 1..n): for each fold, the subjects outside it dealt anew inside their classes."""
    outer = rows.select(F.col("fold").alias("outer")).distinct()
    subjects = rows.select("subject", "y", "fold").distinct().join(outer, F.col("fold") != F.col("outer"))
    placed = ranks.places(subjects.withColumn("_h", folds.shuffled(seed, "subject")), ["outer", "y"], "_h", ["subject"])
    return placed.select("outer", "subject", (F.col("place") % inner + 1).cast("int").alias("inner"))


def best_of(scored: DataFrame, keys: list[str], grid: list) -> DataFrame:
    """(keys, parameter) with the best balanced accuracy of (keys, parameter, bal); the first of the grid wins a tie."""
    place = F.array_position(F.array(*map(F.lit, grid)), F.col("parameter"))
    return scored.groupBy(*keys).agg(F.min_by("parameter", F.struct(-F.round("bal", 9), place)).alias("parameter"))


def knn_grid(rows: DataFrame, grid: list[int], inner: int = 3, seed: int = 11, weighted: bool = True) -> DataFrame:
    """(subject, epoch, y, fold, k, yhat, score): nearest neighbours with the k of the grid that inner folds choose for each fold.

    rows: (subject, epoch, y, fold, outer, features), each row once for each outer fold, scaled by what is outside it.
    The neighbours for the largest k are found once and serve the whole grid. Both classes have the same prior.
    """
    dealt = inner_folds(rows.select("subject", "y", "fold"), inner, seed)
    part = held(rows.filter(F.col("fold") != F.col("outer")).join(dealt, ["outer", "subject"]))
    other = part.select(F.col("inner").alias("_i")).distinct()
    train = part.join(F.broadcast(other), F.col("inner") != F.col("_i")).drop("inner").withColumnRenamed("_i", "inner")
    row = ["subject", "epoch", "y"]
    near = learn.uniform_prior(learn.neighbours(train, part, row, max(grid), ["subject", "epoch"], ["outer", "inner"]), train, ["outer", "inner"])
    tried = learn.voted(near, ["outer", "inner", *row], grid, weighted)
    chosen = best_of(metrics.confusion(tried.withColumnRenamed("k", "parameter"), ["outer", "parameter"]), ["outer"], grid).withColumnRenamed("parameter", "k")
    outside = rows.filter(F.col("fold") != F.col("outer"))
    final = learn.uniform_prior(learn.neighbours(outside, rows.filter(F.col("fold") == F.col("outer")), row, max(grid), ["subject", "epoch"], ["outer"]), outside, ["outer"])
    return learn.voted(final, ["outer", *row], grid, weighted).join(F.broadcast(chosen), ["outer", "k"]).withColumnRenamed("outer", "fold")


def grid_cross_validated(rows: DataFrame, keep: list[str], name: str, parameter: str, grid: list, inner: int = 3, most: int = 6000, seed: int = 11, threads: int = 4, prepare=None, setting=None, **params) -> DataFrame:
    """(keep, y, fold, yhat, score): MLlib learner `name`, with the value of the grid that inner folds of whole subjects choose.

    rows: (keep with subject, y, fold, outer, features), each row once for each outer fold, prepared by what is outside that fold
    alone: the model of a fold and its test rows have one scale, in which the fold's rows had no part. `prepare`, given the training
    part, returns a function of rows (a feature map); `setting`, given a value of the grid and the number of training rows, the
    parameter. The inner search sees at most `most` rows of a training part, each class in proportion; the fit sees all of them.
    Rows without `outer`, which nothing was fitted to prepare, are the same for every fold. Fits are independent jobs, `threads` of them at a time.
    """
    if "outer" not in rows.columns:
        rows = rows.crossJoin(F.broadcast(rows.select(F.col("fold").alias("outer")).distinct()))  # a row for each fold
    rows = held(rows)
    dealt = held(inner_folds(rows.select("subject", "y", "fold"), inner, seed))
    outer = [r[0] for r in rows.select("outer").distinct().orderBy("outer").collect()]  # a few folds

    def predicted(o):
        own = rows.filter(F.col("outer") == o).drop("outer")
        training = own.filter(F.col("fold") != o)
        if prepare:
            own = held(prepare(training)(own))
            training = own.filter(F.col("fold") != o)

        def values(part):
            return [setting(v, part) if setting else v for v in grid]

        best = 0
        if len(grid) > 1:
            few = folds.stratified_sample(training, keep, "y", most, seed).drop("fold").join(dealt.filter(F.col("outer") == o), "subject")
            few = held(few.withColumnRenamed("inner", "fold"))
            n = few.count() * (inner - 1) / inner
            every = reduce(DataFrame.unionByName, [learn.cross_validated(few, "fold", keep, name, 1, **params, **{parameter: v}).withColumn("parameter", F.lit(k)) for k, v in enumerate(values(n))])
            best = best_of(metrics.confusion(every, ["parameter"]).withColumn("fold", F.lit(o)), ["fold"], list(range(len(grid)))).first()["parameter"]
        return learn.fold_predictions(own, "fold", o, keep, name, **params, **{parameter: values(training.count())[best]})

    with ThreadPool(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(predicted, outer))
