"""Permutation of labels among subjects, by moments: rows are shuffled once, however many permutations there are.

Labels and folds of every permutation are lists over the subjects, two small numbers each, dealt in parallel by permutation. Sums of
each feature by permutation, fold and class are then one matrix product of indicators with rows in every Arrow batch, and
what is shuffled of them is a block a task. The models that follow are a table of permutations, folds and features;
the distances of a row to the class centres of all of them are one more matrix product, and its own fold's are taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.sources.stores import held

from . import folds, learn, metrics, ranks

#: Subjects whose labels are dealt as one list; more of them are dealt as rows of a table.
MOST_SUBJECTS = 100_000
#: Permutations of one block of sums.
BLOCK = 16


def order(subjects: list, *words) -> np.ndarray:
    head = ":".join(map(str, words))
    return np.array(sorted(range(len(subjects)), key=lambda i: (hashlib.md5(f"{head}:{subjects[i]}".encode()).hexdigest(), subjects[i])), np.int64)


def fold_of(subjects: list, labels: np.ndarray, perm: int, seed: int, k: int) -> np.ndarray:
    """Folds from 0 on of the subjects in one permutation, dealt in turn inside each class by an order of hashes."""
    fold, by = np.zeros(len(labels), np.int8), order(subjects, seed, perm)
    for c in (0, 1):
        own = by[labels[by] == c]
        fold[own] = np.arange(len(own)) % k
    return fold


def assignments(subjects: DataFrame, n: int, seed: int, fold_seed: int, k: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """(place of each subject, labels, folds), the last two permutations x subjects in a byte each; permutation 0 has the true labels."""
    ids = sorted(r[0] for r in subjects.select("subject").collect())
    labels = learn.permuted_labels(subjects, n, seed).select("perm", "subject", "y").unionByName(subjects.select(F.lit(0).cast("long").alias("perm"), "subject", "y"))
    per = labels.groupBy("perm").agg(F.transform(F.array_sort(F.collect_list(F.struct("subject", "y"))), lambda s: s["y"].cast("int")).alias("ys"))

    def run(batches):
        for b in batches:
            found = [np.array(y, np.int8) for y in b.column("ys").to_pylist()]
            folds_ = [fold_of(ids, y, p, fold_seed, k) for p, y in zip(b.column("perm").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("perm"), *(pa.array([v.tobytes() for v in vs], pa.binary()) for vs in (found, folds_))], names=["perm", "labels", "folds"])

    every = per.mapInArrow(run, "perm long, labels binary, folds binary").orderBy("perm").collect()
    return {s: i for i, s in enumerate(ids)}, *(np.stack([np.frombuffer(r[c], np.int8) for r in every]) for c in ("labels", "folds"))


def features_of(batch) -> np.ndarray:
    flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def moments(rows: DataFrame, place: dict, labels: np.ndarray, fold: np.ndarray, k: int, n_features: int) -> np.ndarray:
    """permutations x folds x classes x features x (count, sum, sum of squares) of rows (subject, features)."""
    n = len(labels)

    def run(batches):
        sums = np.zeros((n, 2 * k, 3 * n_features))
        for b in batches:
            if not b.num_rows:
                continue
            x = features_of(b)
            there = ~np.isnan(x)
            x = np.where(there, x, 0)
            # subjects first, so that the products are of subjects and not of rows
            at, of = np.unique([place[s] for s in b.column("subject").to_pylist()], return_inverse=True)
            by = np.zeros((len(at), 3 * n_features))
            np.add.at(by, of, np.concatenate([there, x, x * x], 1))
            cell = fold[:, at].astype(np.int64) * 2 + labels[:, at]
            for p in range(n):
                hot = np.zeros((2 * k, len(at)))
                hot[cell[p], np.arange(len(at))] = 1
                sums[p] += hot @ by
        blocks = range(0, n, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([sums[i : i + BLOCK].tobytes() for i in blocks], pa.binary())], names=["block", "sums"])

    def added(key, table):
        total = sum(np.frombuffer(s, float) for s in table.column("sums").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("subject", "features").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(added, "block int, sums binary")
    found = {r["block"]: np.frombuffer(r["sums"], float) for r in parts.collect()}
    flat = np.concatenate([found[b] for b in sorted(found)]) if found else np.zeros(n * 2 * k * 3 * n_features)
    return flat.reshape(n, k, 2, 3, n_features).transpose(0, 1, 2, 4, 3)


def centres(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(1 / variance, centre of class 1, of class 0), permutations x folds x features, of the rows outside each fold; weight 0 where a class has none."""
    rest = sums.sum(1, keepdims=True) - sums
    n, s, q = (rest[..., j].sum(2) for j in range(3))
    with np.errstate(all="ignore"):
        sd = np.sqrt(np.maximum((q - s * s / n) / (n - 1), 0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        c0, c1 = (rest[:, :, c, :, 1] / rest[:, :, c, :, 0] for c in (0, 1))
        fine = (rest[:, :, 0, :, 0] > 0.5) & (rest[:, :, 1, :, 0] > 0.5) & np.isfinite(sd)
        return np.where(fine, 1 / (sd * sd), 0.0), np.where(fine, c1, 0.0), np.where(fine, c0, 0.0)


def balance(rows: DataFrame, place: dict, labels: np.ndarray, fold: np.ndarray, sums: np.ndarray) -> DataFrame:
    """(perm, bal): balanced accuracy of subjects by vote of their rows, each scored by the model of its fold, in every permutation."""
    n, k, _, n_features, _ = sums.shape
    weight, c1, c0 = centres(sums)
    # distances are from a common centre, so that squares don't cancel
    middle = sums[0, ..., 1].sum((0, 1)) / np.maximum(sums[0, ..., 0].sum((0, 1)), 1)
    table = np.concatenate([np.concatenate([weight, -2 * (c - middle) * weight, (c - middle) ** 2 * weight], 2) for c in (c1, c0)], 1)
    table = table.reshape(n * 2 * k, 3 * n_features).T

    def run(batches):
        counts, open_ = np.zeros((n, 4), np.int64), None

        def close(held):
            s, rows_, hits, score = held
            share = hits / rows_
            yhat = np.where(share == 0.5, score / rows_ > 0.5, share > 0.5)
            y = labels[:, place[s]] == 1
            for j, m in enumerate((y & yhat, ~y & ~yhat, ~y & yhat, y & ~yhat)):
                counts[:, j] += m

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                x = features_of(b) - middle
                there = ~np.isnan(x)
                x = np.where(there, x, 0)
                names = b.column("subject").to_pylist()
                at = np.array([place[s] for s in names])
                d = np.sqrt(np.maximum(np.concatenate([x * x, x, there], 1) @ table, 0)).reshape(len(x), n, 2, k)
                d = np.take_along_axis(d, fold[:, at].T[:, :, None, None].astype(np.int64), 3)[..., 0]
                with np.errstate(all="ignore"):
                    score = d[:, :, 1] / (d[:, :, 0] + d[:, :, 1])
                score = np.where(np.isnan(score), 0.5, score)
                yhat = d[:, :, 0] < d[:, :, 1]
                edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for i, j in zip(edges, edges[1:], strict=False):
                    if open_ is not None and open_[0] != names[i]:
                        close(open_)
                        open_ = None
                    one = open_ or (names[i], 0, 0, 0)
                    open_ = (names[i], one[1] + j - i, one[2] + yhat[i:j].sum(0), one[3] + score[i:j].sum(0))
        if open_ is not None:
            close(open_)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(counts[:, j]) for j in range(4))], names=["perm", "tp", "tn", "fp", "fn"])

    parts = rows.select("subject", "features").mapInArrow(run, "perm long, tp long, tn long, fp long, fn long")
    c = parts.groupBy("perm").agg(*[F.sum(x).alias(x) for x in ("tp", "tn", "fp", "fn")])
    share = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return c.select("perm", (50 * (share("tp", "fn") + share("tn", "fp"))).alias("bal"))


def by_copies(long: DataFrame, n: int, seed: int, fold_seed: int, k: int) -> DataFrame:
    """permuted_balance() by a copy of the rows for each permutation: for lists of subjects that aren't small."""
    subjects = long.select("subject", "y").distinct()
    labels = learn.permuted_labels(subjects, n, seed).unionByName(subjects.withColumn("perm", F.lit(0).cast("long")))
    placed = ranks.places(labels.withColumn("_h", folds.shuffled(fold_seed, "perm", "subject")), ["perm", "y"], "_h", ["subject"])
    many = held(long.drop("y").join(placed.select("perm", "subject", "y", (F.col("place") % k + 1).alias("fold")), "subject"))
    p = learn.centroid_predictions(many, learn.centroid_models(many, ["perm"]), ["perm", "subject", "epoch", "y"], ["perm", "fold"])
    return metrics.confusion(metrics.vote(held(p), ["perm", "subject"]), ["perm"]).select("perm", "bal")


def permuted_balance(long: DataFrame, n: int, seed: int = 5, fold_seed: int = 1, k: int = 5, most: int = MOST_SUBJECTS) -> DataFrame:
    """(perm, bal): balanced accuracy by subject of the centroid learner in folds of subjects, for the true labels (perm 0) and n permutations of them.

    long: (subject, epoch, y, feature, value). Missing values are left out of sums and distances.
    """
    subjects = held(long.select("subject", "y").distinct())
    if subjects.count() > most:
        return by_copies(long, n, seed, fold_seed, k)
    names = [r[0] for r in long.select("feature").distinct().orderBy("feature").collect()]
    rows = held(learn.wide(long, ["subject", "epoch"], names).repartition("subject").sortWithinPartitions("subject"))
    place, labels, fold = assignments(subjects, n, seed, fold_seed, k)
    return balance(rows, place, labels, fold, moments(rows, place, labels, fold, k, len(names)))
