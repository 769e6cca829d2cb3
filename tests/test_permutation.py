"""Permutation by moments against a copy of the rows for each permutation."""

import numpy as np
import pytest

from epochlake.operators import learn, permutation


@pytest.fixture(scope="module")
def long(spark):
    r = np.random.default_rng(8)
    rows = []
    for s in range(23):
        for e in range(int(r.integers(1, 5))):
            for f, shift in (("a", 1000.0), ("b", 0.0), ("c", -3.0)):
                v = shift + (s % 2) * 0.8 + r.normal()
                rows.append((s, e, s % 2, f, None if r.random() < 0.05 else float(v)))
    rows += [(s, 9, s % 2, "flat", 4.0) for s in range(23)]
    return spark.createDataFrame(rows, "subject long, epoch long, y int, feature string, value double").repartition(5)


def test_equals_copies_of_the_rows(long):
    got = {r["perm"]: r["bal"] for r in permutation.permuted_balance(long, 20, k=4).collect()}
    want = {r["perm"]: r["bal"] for r in permutation.by_copies(long, 20, 5, 1, 4).collect()}
    assert set(got) == set(range(21)) and got == pytest.approx(want, abs=1e-9)


def test_many_subjects_take_the_other_way(long):
    got = {r["perm"]: r["bal"] for r in permutation.permuted_balance(long, 3, k=4, most=5).collect()}
    assert got == pytest.approx({r["perm"]: r["bal"] for r in permutation.permuted_balance(long, 3, k=4).collect()}, abs=1e-9)


def test_labels_are_those_of_the_table(spark, long):
    subjects = long.select("subject", "y").distinct()
    place, labels, _ = permutation.assignments(subjects, 6, 5, 1, 4)
    for r in learn.permuted_labels(subjects, 6, 5).collect():
        assert labels[r["perm"], place[r["subject"]]] == r["y"]


def test_rows_move_once_whatever_the_permutations(long):
    plans = []
    for n in (2, 50):
        df = permutation.permuted_balance(long, n, k=4)
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert plans[0] == plans[1]
