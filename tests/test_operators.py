"""Invariants and edge cases on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from epochlake.functions import batches
from epochlake.functions import features as ft
from epochlake.operators import epochs, folds, joins, learn, matching, metrics, statistics
from epochlake.sources import recordings, stores


def arrays(spark, *xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "id int, x array<double>")


def test_constant_ramp_and_sine(spark):
    fs = 128
    sine = [math.sin(2 * math.pi * 10 * i / fs + 0.1) for i in range(256)]
    df = arrays(spark, [1.0] * 64, range(64), sine)
    x = F.col("x")
    got = df.select(ft.phase_space(x).alias("p"), ft.permutation_entropy(x, 3).alias("e"), ft.time_domain(x).alias("t"), ft.petrosian(x).alias("d"), batches.named(batches.over(lambda v: batches.band_power(v, fs), 12, x), batches.BAND_COLUMNS).alias("b")).collect()
    assert got[0]["p"] is None and got[0]["t"]["skewness"] is None
    assert got[1]["e"] == pytest.approx(0) and got[1]["d"] == pytest.approx(1) and got[1]["t"]["line_length"] == 1
    assert got[2]["t"]["mobility"] == pytest.approx(2 * math.sin(math.pi * 10 / fs), rel=0.01)
    assert got[2]["b"]["alpha"] > 0.95
    assert got[1]["p"]["cem"] == pytest.approx(math.pi * got[1]["p"]["tms"])


def test_short_arrays_do_not_fail(spark):
    df = arrays(spark, [], [1.0], [1.0, 2.0])
    x = F.col("x")
    got = df.select(ft.time_domain(x).alias("t"), ft.permutation_entropy(x, 3).alias("e"), ft.sample_entropy(x).alias("s"), ft.phase_space(x).alias("p")).collect()
    assert [r["p"] for r in got] == [None] * 3 and [r["s"] for r in got] == [None] * 3


def test_one_spike_is_the_only_rejected_epoch(spark):
    rng = random.Random(0)
    rows = [(1, e, [rng.uniform(-1, 1) for _ in range(32)]) for e in range(20)]
    rows[7] = (1, 7, [100.0, -100.0] * 16)
    rows.append((2, 0, [1.0, 2.0]))
    df = spark.createDataFrame(rows, "subject int, epoch int, x array<double>")
    got = {(r["subject"], r["epoch"]) for r in epochs.reject(df, ["subject"], ["subject", "epoch"]).filter("rejected").collect()}
    assert got == {(1, 7)}


def test_folds_are_grouped_and_balanced(spark):
    s = spark.createDataFrame([(i, i % 2) for i in range(41)], "subject int, y int")
    got = folds.grouped_folds(s.union(s), "subject", "y", 5, 1).collect()
    assert len(got) == 41
    for y in (0, 1):
        sizes = [sum(r["fold"] == k and r["y"] == y for r in got) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1


def test_statistics_never_see_the_test_rows(spark):
    long = spark.createDataFrame([(i, "f", float(i)) for i in range(10)] + [(3, "empty", None)], "subject int, feature string, value double")
    dealt = spark.createDataFrame([(i, i % 2) for i in range(10)], "subject int, fold int")
    got = {(r["fold"], r["feature"]): r for r in folds.training_statistics(long, dealt, "subject").collect()}
    assert got[(0, "f")]["mean"] == 5 and got[(1, "f")]["mean"] == 4
    assert got[(0, "empty")]["med"] == 0 and got[(0, "empty")]["sd"] == 1


def test_auc_vote_and_empty_classes(spark):
    p = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 0, 0, 0.5), ("a", 1, 1, 0.9), ("b", 1, 1, 0.2), ("c", 0, 1, 0.4), ("c", 0, 0, 0.8)], "k string, y int, yhat int, score double")
    auc = {r["k"]: r["auc"] for r in metrics.auc(p, ["k"]).collect()}
    assert auc == {"a": 0.75, "b": None, "c": None}
    flipped = {r["k"]: r["auc"] for r in metrics.auc(p.withColumn("score", -F.col("score")), ["k"]).collect()}
    assert flipped["a"] == 1 - auc["a"]
    votes = {r["k"]: r["yhat"] for r in metrics.vote(p, ["k"]).collect()}
    assert votes["c"] == 1  # a tie goes to the mean score of 0.6
    assert metrics.confusion(p, ["k"]).filter("k = 'b'").first()["mcc"] == 0


def test_matching_without_replacement(spark):
    rows = [("c", i, 1, i % 2, 20.0 + i) for i in range(3)] + [("c", 10, 0, 0, 21.0), ("c", 11, 0, 0, 60.0), ("c", 12, 0, 0, None)]
    got = matching.matched(spark.createDataFrame(rows, "cohort string, id int, group int, sex int, age double"), "cohort").collect()
    controls = [r["id"] for r in got if r["group"] == 0]
    assert sorted(controls) == [10, 11] and len([r for r in got if r["group"] == 1]) == 2


def test_numbered_rows_and_first_match(spark):
    df = spark.createDataFrame([(random.Random(i).randrange(50), i) for i in range(300)], "a long, b long")
    got = joins.numbered(df, ["a", "b"], 7).orderBy("row").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got) and [r["row"] for r in got] == list(range(1, 301))
    right = spark.createDataFrame([(1, 5, "late"), (1, 2, "first")], "k int, at int, v string")
    assert joins.first_match(spark.createDataFrame([(1,), (2,)], "k int"), right, ["k"], ["at"]).orderBy("k").select("v").collect() == [("first",), (None,)]


def test_percentiles_and_benjamini_hochberg(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0)], "g string, v double")
    got = {r["percent"]: r["value"] for r in statistics.percentiles(df, ["g"], "v", [0, 25, 50, 75, 100]).collect()}
    assert got == {0: 1, 25: 1.5, 50: 2.5, 75: 3.5, 100: 4}
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.001, 0.04, 0.02, 0.9])], "k int, p double")
    assert {r["k"] for r in statistics.benjamini_hochberg(p, "k").filter("selected").collect()} == {0, 2}


def test_subject_identity_leaks_only_through_row_folds(spark):
    rng = random.Random(4)
    rows = []
    for s in range(20):
        centre = rng.gauss(0, 10)
        rows += [(s, s % 2, e, "f", centre + rng.gauss(0, 0.1)) for e in range(10)]
    long = spark.createDataFrame(rows, "subject int, y int, epoch int, feature string, value double")
    dealt = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", 5, 1).select("subject", "fold")
    own = long.join(dealt, "subject")
    p = learn.centroid_predictions(own, learn.centroid_models(own, []), ["subject", "epoch", "y"], ["fold"])
    assert p.count() == 200 and {r["yhat"] for r in p.collect()} <= {0, 1}


def test_forest_and_nearest(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, i % 3, [rng.gauss(4 * (i % 2), 1), None if i % 10 == 0 else rng.gauss(0, 1)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, y int, fold int, features array<double>")
    got = learn.cross_validated(df, "fold", ["id"], "forest", numTrees=5).collect()
    assert len(got) == 120 and sum(r["y"] == r["yhat"] for r in got) > 105
    fine = df.filter("id % 10 <> 0")
    near = learn.nearest(fine.filter("fold > 0"), fine.filter("fold = 0"), ["id", "y"], 5).collect()
    assert sum(r["y"] == r["yhat"] for r in near) > 0.8 * len(near)


def test_stores_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("D1", "td", 1), ("undetermined", "td", 2)], "dataset string, family string, v int")
    path = f"{tmp_path}/store"
    stores.save(df, path, ["family", "dataset"])
    stores.save(df.limit(0), path, ["family", "dataset"])  # a finished store stays
    assert stores.load(spark, path, exclude={"dataset": ["undetermined"]}, family="td").count() == 1
    assert stores.load(spark, f"{tmp_path}/none") is None
    (tmp_path / "t.csv").write_text("id,ADHD," + ",".join(["1.5"] * 26) + "\nshort,row\nid2,HC," + ",".join(["1"] * 25 + ["x"]) + "\n")
    got = recordings.read_subject_table(spark, f"{tmp_path}/t.csv").collect()
    assert [(r["id"], r["group"], len(r["levels"])) for r in got] == [("id", "ADHD", 26)]
    (tmp_path / "r.csv").write_text("timestamps,Fz (uV),Cz(uV)\n0,1,2\n0.5,nan,2\n1,3,4\n2,5,6\n")
    samples, rates = recordings.read_channel_csv(spark, f"{tmp_path}/r.csv", ["Fz", "Cz"])
    assert samples.count() == 3 and rates.first()["fs"] == 1
    (tmp_path / "d.json").write_text('[{"user": "u1", "diagnosed": " Yes", "age": 30, "gender": 1}]')
    assert recordings.read_demographics(spark, f"{tmp_path}/d.json").first()["diagnosed"] == "yes"


def test_grid_search_prefers_what_generalises(spark):
    from epochlake.operators import protocols

    rng = random.Random(7)
    rows = [(s, e, s % 2, s // 2 % 3, [(1 if rng.random() < 0.85 else -1) * (3.0 if s % 2 else -3.0) + rng.gauss(0, 0.5), rng.gauss(0, 1)]) for s in range(18) for e in range(10)]
    df = spark.createDataFrame(rows, "subject int, epoch int, y int, fold int, features array<double>")
    got = protocols.grid_cross_validated(df, ["subject", "epoch"], "tree", "minInstancesPerNode", [1, 20]).collect()
    assert len(got) == 180 and len({(r["subject"], r["epoch"]) for r in got}) == 180
    assert sum(r["y"] == r["yhat"] for r in got) > 140


def test_best_of_grid_takes_the_first_of_equals(spark):
    from epochlake.operators import protocols

    df = spark.createDataFrame([(1, 5, 60.0), (1, 15, 70.0), (1, 35, 70.0), (2, 35, 50.0), (2, 5, 50.0)], "outer int, parameter int, bal double")
    assert {r["outer"]: r["parameter"] for r in protocols.best_of(df, ["outer"], [5, 15, 35]).collect()} == {1: 15, 2: 5}


def test_parts_follow_each_other(spark):
    df = spark.createDataFrame([(p, v) for p, vs in ((10, [4, 2]), (2, [9, 1, 5]), (1, [7])) for v in vs], "part int, v int")
    got = [(r["part"], r["v"]) for r in joins.in_parts(df, "part", ["v"]).orderBy("row").collect()]
    assert got == [(1, 7), (2, 1), (2, 5), (2, 9), (10, 2), (10, 4)]


def test_percentiles_with_repeated_values_as_plain_ones(spark):
    rng = random.Random(9)
    values = {g: [float(rng.randrange(6)) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 57))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    for r in statistics.percentiles(df, ["g"], "v", [0, 10, 37.5, 50, 99, 100]).collect():
        vs = sorted(values[r["g"]])
        at = min(max(1.0, r["percent"] / 100 * len(vs) + 0.5), len(vs))
        low = int(at)
        want = vs[low - 1] + (at - low) * (vs[min(low, len(vs) - 1)] - vs[low - 1])
        assert abs(r["value"] - want) < 1e-12


def test_lookup_and_routes(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", None, 7)], "k string, n int, v int")
    assert [tuple(r) for r in joins.lookup(df, {"k": "a", "n": 1}, ["v"], ["v"]).collect()] == [(3,)]
    assert joins.lookup(df, {"k": "b", "n": None}, ["v"], ["v"]).first()["v"] == 7 and joins.lookup(df, {"k": "z"}, ["v"], ["v"]).count() == 0
    routed = {r["k"]: (r["store"], r["label"]) for r in joins.routed(df, "k", {"a": ("main", 1)}, ("rest", 0)).collect()}
    assert routed == {"a": ("main", 1), "b": ("rest", 0)}
