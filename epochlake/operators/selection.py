"""Feature selection: ranks inside folds, the number of features by inner folds, and wrapper search.

A wrapper's population is a small table of masks; each round scores all of them in
one job against a bounded sample of training rows, and the driver holds only the
positions of the population.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds, learn, metrics, ranks, statistics


def ranked(models: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid models with rank: features by the distance of the class centres, ties to the lower name."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col("c1") - F.col("c0")).desc(), "feature")
    return models.withColumn("rank", F.row_number().over(order))


def choose_k(long: DataFrame, grid: list[int], inner: int = 3, seed: int = 11) -> DataFrame:
    """(outer, k): for each outer fold, the k of the grid with the best balanced accuracy on inner folds of its training subjects.

    long: (subject, epoch, y, feature, value, fold). The first k wins a tie. All folds and values of k
    are one job: a distance over the k best features is a sum over ranks up to k.
    """
    outer = long.select("fold").distinct().withColumnRenamed("fold", "outer")
    training = long.join(outer, F.col("fold") != F.col("outer")).drop("fold")
    subjects = training.select("outer", "subject", "y").distinct()
    placed = ranks.places(subjects.withColumn("_h", folds.shuffled(seed, "subject")), ["outer", "y"], "_h", ["subject"])
    inner_folds = placed.select("outer", "subject", (F.col("place") % inner + 1).alias("fold"))
    rows = training.join(inner_folds, ["outer", "subject"])
    models = ranked(learn.centroid_models(rows, ["outer"]), ["outer", "fold"])
    many = models.withColumn("k", F.explode(F.array(*map(F.lit, grid)))).filter(F.col("rank") <= F.col("k")).drop("rank")
    p = learn.centroid_predictions(rows, many, ["outer", "k", "subject", "epoch", "y"], ["outer", "fold"])
    scores = metrics.confusion(p, ["outer", "k"]).withColumn("position", F.array_position(F.array(*map(F.lit, grid)), F.col("k")))
    return scores.groupBy("outer").agg(F.min_by("k", F.struct(-F.round("bal", 9), F.col("position"))).alias("k"))


def nested_predictions(long: DataFrame, grid: list[int]) -> DataFrame:
    """(subject, epoch, y, yhat, score): per outer fold, scaling, ranks and k from its training rows only."""
    chosen = choose_k(long, grid).withColumnRenamed("outer", "fold")
    models = ranked(learn.centroid_models(long, []), ["fold"]).join(chosen, "fold").filter(F.col("rank") <= F.col("k")).drop("rank", "k")
    return learn.centroid_predictions(long, models, ["subject", "epoch", "y"], ["fold"])


def kept_by_test(tests: DataFrame, key: str, least: int, p: str = "p", q: float = 0.05) -> DataFrame:
    """Candidates that the Benjamini-Hochberg test selects; all of them, if it selects fewer than `least`."""
    done = statistics.benjamini_hochberg(tests, key, p, q)
    few = done.agg((F.count_if("selected") < least).alias("_few"))
    return done.crossJoin(F.broadcast(few)).filter("selected OR _few").drop("_few")


def wrapper_fitness(spark, x: np.ndarray, y: np.ndarray, group: np.ndarray, k: int = 5, alpha: float = 0.99):
    """A function of masks (population x features) to losses: alpha * error of grouped nearest neighbours + (1 - alpha) * share selected.

    x, y, group: a bounded sample of training rows (at most 1500, the cap of the reference's search).
    """
    if len(x) > 1500:
        raise ValueError("sample at most 1500 rows for a wrapper search")
    part = group % 3
    known: dict[tuple, float] = {}

    def losses(masks: np.ndarray) -> np.ndarray:
        asked = [tuple(bool(v) for v in m) for m in masks]
        # a mask has one loss, however often a search comes back to it
        new = [m for m in dict.fromkeys(asked) if m not in known]
        if new:
            known.update(zip(new, scored(new), strict=True))
        return np.array([known[m] for m in asked])

    def scored(masks: list[tuple]) -> list[float]:
        def run(frames):
            for f in frames:
                out = []
                for m in f["mask"]:
                    on = np.asarray(m, bool)
                    wrong = 1.0
                    if on.any():
                        hits = 0
                        for p in range(3):
                            te, tr = part == p, part != p
                            d = ((x[te][:, None, on] - x[tr][None][:, :, on]) ** 2).sum(2)
                            near = y[tr][np.argsort(d, axis=1, kind="stable")[:, :k]]
                            hits += int(((near.mean(1) > 0.5) == (y[te] == 1)).sum())
                        wrong = 1 - hits / len(y)
                    out.append(alpha * wrong + (1 - alpha) * on.mean())
                yield pd.DataFrame({"i": f["i"], "loss": out})

        table = spark.createDataFrame([(i, list(m)) for i, m in enumerate(masks)], "i int, mask array<boolean>")
        found = table.repartition(min(len(masks), 8)).mapInPandas(run, "i int, loss double").collect()
        return [r["loss"] for r in sorted(found)]

    return losses


def grey_wolves(losses, n: int, wolves: int = 8, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Mask of the best wolf: positions move to the mean of steps around the three best, ever smaller."""
    rng = np.random.default_rng(seed)
    x = rng.random((wolves, n))
    leaders: list[tuple[float, np.ndarray]] = []
    for t in range(rounds):
        for loss, p in zip(losses(x >= 0.5), x, strict=True):
            leaders.append((float(loss), p.copy()))
        leaders = sorted(leaders, key=lambda a: a[0])[:3]
        a = 2 * (1 - t / rounds)
        steps = [lead - a * (2 * rng.random(x.shape) - 1) * np.abs(2 * rng.random(x.shape) * lead - x) for _, lead in leaders]
        x = np.clip(np.mean(steps, axis=0), 0, 1)
    return leaders[0][1] >= 0.5


def levy(rng, shape, beta: float = 1.5) -> np.ndarray:
    sigma = (math.gamma(1 + beta) * math.sin(math.pi * beta / 2) / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)
    return 0.01 * rng.normal(0, sigma, shape) / np.abs(rng.normal(0, 1, shape)) ** (1 / beta)


def aquila(losses, n: int, eagles: int = 8, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Mask of the best eagle: wide and narrow exploration for two thirds of the rounds, then two kinds of attack."""
    rng = np.random.default_rng(seed)
    x = rng.random((eagles, n))
    loss = losses(x >= 0.5)
    best, least = x[loss.argmin()].copy(), float(loss.min())
    for t in range(1, rounds + 1):
        new = np.empty_like(x)
        for i in range(eagles):
            r = rng.random()
            if t <= 2 * rounds / 3 and r < 0.5:
                new[i] = best * (1 - t / rounds) + x.mean(0) - best * rng.random()
            elif t <= 2 * rounds / 3:
                turn = 10 + 0.00565 * np.arange(1, n + 1)
                angle = -0.005 * np.arange(1, n + 1) + 1.5 * math.pi
                new[i] = best * levy(rng, n) + x[rng.integers(eagles)] + turn * (np.cos(angle) - np.sin(angle)) * rng.random()
            elif r < 0.5:
                new[i] = (best - x.mean(0)) * 0.1 - rng.random() + rng.random() * 0.1
            else:
                quality = t ** ((2 * rng.random() - 1) / (1 - rounds) ** 2)
                new[i] = quality * best - (2 * rng.random() - 1) * x[i] * rng.random() - 2 * (1 - t / rounds) * levy(rng, n) + rng.random() * (2 * rng.random() - 1)
        new = np.clip(new, 0, 1)
        found = losses(new >= 0.5)
        better = found < loss
        x[better], loss[better] = new[better], found[better]
        if loss.min() < least:
            best, least = x[loss.argmin()].copy(), float(loss.min())
    return best >= 0.5
