"""Exact medians by narrowing histograms against sorted lists."""

import numpy as np
import pytest

from epochlake.operators import folds, middles


def values(seed=1):
    r = np.random.default_rng(seed)
    out = {
        "normal": r.normal(size=701).tolist(), "equal": [3.5] * 400, "half": [1.0] * 300 + r.normal(5, 1, 300).tolist(), "wide": (10.0 ** r.uniform(-300, 300, 501)).tolist(),
        "ends": [1e308, -1e308, 0.0, 5e-324, -5e-324, float("inf"), float("-inf")], "one": [7.25], "two": [1.0, 2.0], "ints": r.integers(0, 4, 900).astype(float).tolist(),
        "gap": [None, float("nan"), 2.0, None, 9.0], "none": [None, None],
    }
    return [(k, i % 3 + 1, v) for k, vs in out.items() for i, v in enumerate(vs)]


def middle(vs):
    vs = sorted(v for v in vs if v is not None and v == v)
    return (vs[(len(vs) - 1) // 2] / 2 + vs[len(vs) // 2] / 2) if vs else None


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(values(), "feature string, fold int, value double").repartition(4)


@pytest.mark.parametrize("small", [4096, 5])
def test_medians_by_key(rows, monkeypatch, small):
    monkeypatch.setattr(middles, "SMALL", small)
    got = {r["feature"]: r["med"] for r in middles.medians(rows, ["feature"], "value").collect()}
    want = {k: middle([v for f, _, v in values() if f == k]) for k in {f for f, *_ in values()}}
    assert got == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("small", [4096, 5])
def test_medians_outside_folds(rows, monkeypatch, small):
    monkeypatch.setattr(middles, "SMALL", small)
    monkeypatch.setattr(middles, "FEW_KEYS", 3)
    got = {(r["feature"], r["fold"]): r["med"] for r in middles.medians(rows, ["feature"], "value", "fold").collect()}
    for k in {f for f, *_ in values()}:
        for o in (1, 2, 3):
            assert got.get((k, o)) == middle([v for f, g, v in values() if f == k and g != o])


def test_no_buffer_of_a_feature_in_the_plan(spark):
    long = spark.createDataFrame([(s, "f", float(s)) for s in range(30)], "subject int, feature string, value double")
    dealt = spark.createDataFrame([(s, s % 3 + 1) for s in range(30)], "subject int, fold int")
    for df in (folds.training_statistics(long, dealt, "subject"), folds.robust_scaled(long, dealt, "subject")):
        assert "percentile" not in df._jdf.queryExecution().toString().lower()


def test_no_rows(spark):
    assert middles.medians(spark.createDataFrame([], "feature string, value double"), ["feature"], "value").collect() == []
