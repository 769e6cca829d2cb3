"""Inner grids without leaks, kernel features, class priors, and stacks with an epoch that fails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.functions import batches
from epochlake.operators import folds, learn, protocols


def planted(seed=3, subjects=24, epochs=4):
    """Rows of two classes that a ring separates: (subject, epoch, y, feature, value)."""
    r = np.random.default_rng(seed)
    out = []
    for s in range(subjects):
        y = s % 2
        for e in range(epochs):
            angle, radius = r.uniform(0, 2 * np.pi), (1.0 if y else 3.0) + r.normal(0, 0.15)
            out += [(s, e, y, "a", float(radius * np.cos(angle))), (s, e, y, "b", float(radius * np.sin(angle)))]
    return out


def folded(spark, rows, k=3):
    long = spark.createDataFrame(rows, "subject int, epoch int, y int, feature string, value double")
    dealt = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", k, 1).select("subject", "fold")
    z = folds.scaled(long, folds.training_statistics(long, dealt, "subject")).withColumnRenamed("fold", "outer").drop("value").withColumnRenamed("z", "value")
    return learn.wide(z, ["outer", "subject", "epoch", "y"], ["a", "b"]).join(dealt, "subject"), {r["subject"]: r["fold"] for r in dealt.collect()}


SVM = {"prepare": lambda t: learn.nystroem(t, ["subject", "epoch"], 40), "setting": lambda c, n: 1 / (c * n), "maxIter": 30}
LEARNERS = {"tree": ("minInstancesPerNode", [1, 5], {}), "svm": ("regParam", [10.0], SVM)}


def scores(spark, rows, name):
    wide, fold_of = folded(spark, rows)
    parameter, grid, more = LEARNERS[name]
    p = protocols.grid_cross_validated(wide, ["subject", "epoch"], name, parameter, grid, **more)
    return {(r["subject"], r["epoch"]): r for r in p.collect()}, fold_of


@pytest.mark.parametrize("name", list(LEARNERS))
def test_a_fold_has_no_part_in_its_own_model(spark, name):
    rows = planted()
    before, fold_of = scores(spark, rows, name)
    assert len(before) == 96
    assert sum(r["yhat"] == r["y"] for r in before.values()) >= 86
    # one subject's values grow a thousandfold: other subjects of its fold are scored by models that never saw it
    odd = next(s for s, f in sorted(fold_of.items()) if f == 1)
    after, _ = scores(spark, [(s, e, y, f, v * 1000 if s == odd else v) for s, e, y, f, v in rows], name)
    same = [k for k in before if fold_of[k[0]] == 1 and k[0] != odd]
    assert same and all(before[k]["score"] == pytest.approx(after[k]["score"], abs=1e-9) for k in same)
    assert any(before[k]["score"] != after[k]["score"] for k in before if fold_of[k[0]] != 1)


def test_kernel_machine_agrees_with_kernel_ridge(spark):
    rows = planted(5)
    found, _ = scores(spark, rows, "svm")
    wide, fold_of = folded(spark, rows)
    every = wide.collect()
    agree = n = 0
    for o in sorted(set(fold_of.values())):
        tr = [r for r in every if r["outer"] == o and r["fold"] != o]
        te = [r for r in every if r["outer"] == o and r["fold"] == o]
        x, q = np.array([r["features"] for r in tr]), np.array([r["features"] for r in te])
        y = np.array([1.0 if r["y"] else -1.0 for r in tr])
        far = ((x[:, None] - x) ** 2).sum(2)
        scale = np.median(far[np.triu_indices(len(x), 1)])
        a = np.linalg.solve(np.exp(-far / scale) + 0.1 * np.eye(len(x)), y)
        s = np.exp(-((q[:, None] - x) ** 2).sum(2) / scale) @ a
        agree += sum((v > 0) == (found[r["subject"], r["epoch"]]["yhat"] == 1) for r, v in zip(te, s))
        n += len(te)
    assert agree >= 0.95 * n


def test_kernel_features_multiply_to_the_kernel(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    f = np.array([row["features"] for row in learn.nystroem(df, ["id"], 40)(df).orderBy("id").collect()])
    far = ((x[:, None] - x) ** 2).sum(2)
    scale = np.median(far[np.triu_indices(40, 1)])
    assert np.abs(f @ f.T - np.exp(-far / scale)).max() < 1e-6


def test_a_uniform_prior_lets_the_smaller_class_win(spark):
    train = [(i, 0, [float(i)]) for i in range(8)] + [(20, 1, [3.5])]
    df = spark.createDataFrame(train, "id int, y int, features array<double>")
    asked = spark.createDataFrame([(1, [3.4])], "q int, features array<double>")
    near = learn.neighbours(df, asked, ["q"], 3, ["id"])
    assert learn.voted(near, ["q"], [3], False).first()["yhat"] == 0
    with_prior = learn.voted(learn.uniform_prior(near, df, []), ["q"], [3], False).first()
    assert with_prior["yhat"] == 1 and with_prior["score"] == pytest.approx((1 / 1) / (1 + 2 / 8))


def test_an_epoch_that_fails_is_null_alone(spark):
    def picky(x):
        if (x[:, 0] == 7).any():
            raise ValueError
        return x[:, :1] * 2

    rows = [(i, [float(i), 1.0]) for i in range(11)] + [(11, None), (12, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>").coalesce(1)
    out = {r["id"]: r["v"] for r in df.select("id", batches.over(picky, 1, F.col("x")).alias("v")).collect()}
    assert out == {i: ([None] if i in (7, 11, 12) else [2.0 * i]) for i in range(13)}


def test_nested_choice_of_features_by_inner_folds(spark):
    r = np.random.default_rng(4)
    rows = []
    for s in range(30):
        for e in range(3):
            rows += [(s, e, s % 2, "a", float(s % 2 + r.normal(0, 0.3))), (s, e, s % 2, "b", float(r.normal())), (s, e, s % 2, "c", float(r.normal()))]
    long = spark.createDataFrame(rows, "subject int, epoch int, y int, feature string, value double")
    dealt = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", 2, 1).select("subject", "fold")
    long = long.join(dealt, "subject")
    wide = learn.wide(long, ["subject", "epoch", "y", "fold"], ["a", "b", "c"])
    p = protocols.nested_forest(wide, long, ["a", "b", "c"], [1, 3], inner=2, name="tree", minInstancesPerNode=5).collect()
    assert len(p) == 90 and sum(x["yhat"] == x["y"] for x in p) >= 80
    only = protocols.columns_of(wide, ["a", "b", "c"], ["c", "a"]).first()
    full = wide.filter(f"subject = {only['subject']} AND epoch = {only['epoch']}").first()
    assert only["features"] == [full["features"][2], full["features"][0]]


def test_no_medians_are_sorted_for_columns_without_gaps(spark, monkeypatch):
    from pyspark.ml import feature

    asked = []
    fit = feature.Imputer.fit
    monkeypatch.setattr(feature.Imputer, "fit", lambda self, *a: asked.append(self.getInputCols()) or fit(self, *a))
    r = np.random.default_rng(3)
    rows = [(i, i % 2, i % 2 + 1, [float(i % 2) + v, None if i == 5 else w]) for i, (v, w) in enumerate(r.normal(size=(60, 2)).tolist())]
    df = spark.createDataFrame([(i, y, 1 + i // 30, f) for i, y, _, f in rows], "id int, y int, fold int, features array<double>")
    assert learn.cross_validated(df, "fold", ["id"], "svm", maxIter=3).count() == 60
    assert asked == [["f1"], ["f1"]]
