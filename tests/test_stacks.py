"""Decomposition of stacks against the code for one epoch, and features of modes against plain ones."""

import os

import numpy as np
import pytest

from epochlake.functions import batches, decompose
from epochlake.plans import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def stack(n, seed=2):
    r = np.random.default_rng(seed)
    t = np.arange(n) / 128
    x = [r.normal(size=n) for _ in range(12)] + [np.sin(2 * np.pi * f * t) + 0.3 * np.sin(2 * np.pi * 3 * f * t + 1) for f in (2.0, 5.5, 11.0)]
    return np.stack([*x, np.zeros(n), np.linspace(0, 1, n), np.r_[np.zeros(n - 2), 1.0, 0.0], np.cumsum(r.normal(size=n)), np.sign(np.sin(9 * t))])


@pytest.mark.parametrize("n", [16, 64, 129, 256])
def test_empirical_modes_of_a_stack(n):
    x = stack(n)
    found, has, rest = decompose.empirical_stack(x)
    for row, modes, there, left in zip(x, found, has, rest, strict=True):
        want = decompose.empirical_modes(row)
        assert there.sum() == len(want) - 1
        assert np.abs(left - want[-1]).max() < 1e-9
        for a, b in zip(modes[there], want, strict=False):
            assert np.abs(a - b).max() < 1e-9


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_wavelet_modes_of_a_stack(parts):
    for n in (3, 8, 64, 129):
        x = np.concatenate([stack(n), np.eye(n)[:1]])
        found, has = decompose.wavelet_stack(x, parts)
        for row, modes, there in zip(x, found, has, strict=True):
            want = decompose.wavelet_modes(row, parts)
            assert there.sum() == len(want)
            assert np.abs(modes[: len(want)] - np.array(want)).max() < 1e-9


def test_splines_of_a_stack():
    r = np.random.default_rng(5)
    counts, n = np.array([4, 7, 12]), 40
    at, values = np.cumsum(np.ones((3, 12)), 1) + 500, np.zeros((3, 12))
    for i, c in enumerate(counts):
        at[i, :c] = np.r_[-3, np.sort(r.choice(np.arange(1, n - 1), c - 2, replace=False)), n + 5]
        values[i, :c] = r.normal(size=c)
    got = decompose.splines(at, values, counts, n)
    for i, c in enumerate(counts):
        want = decompose.spline((at[i, :c] + 3).astype(int), values[i, :c], n + 3)[3:]
        assert np.abs(got[i] - want).max() < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_phase_space_of_modes(spark):
    from epochlake.plans.feature_queries import store

    got = {(r["vec_id"], r["imf"], r["mode"]): r for r in registry.QUERIES["mode_phase_space"](spark, DATA).filter("vec_id < 12").collect()}
    seen = 0
    for e in store(spark, DATA).filter("vec_id < 12").collect():
        found = decompose.empirical_modes(batches.z(np.array(e["x"])[None])[0])[:-1]
        for i in range(4):
            parts = decompose.wavelet_modes(found[i]) if i < len(found) else []
            for j in range(2):
                r = got[e["vec_id"], i + 1, j + 1]
                if j >= len(parts):
                    assert all(r[c] is None for c in (*batches.PSR2, *batches.PSR3))
                    continue
                for names, fn in ((batches.PSR2, batches.phase_space), (batches.PSR3, batches.phase_space_3d)):
                    for c, v in zip(names, fn(parts[j][None])[0], strict=True):
                        assert r[c] is None and not np.isfinite(v) or r[c] == pytest.approx(v, abs=2e-6, rel=1e-6)
                        seen += 1
    assert seen > 500


def test_modes_and_their_features_are_held_for_a_few_epochs_at_a_time(spark):
    df = spark.range(4000, numPartitions=1).selectExpr("id", "transform(sequence(1, 64), i -> sin(i * (id % 7 + 2) / 9D) + sin(i * 2.1D + id)) AS x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        m = decompose.modes(df, ["id"])
        assert m.count() == 4000 * 8
        # no batch of all modes goes between Spark and Python
        assert "ArrowEvalPython" not in m._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = np.zeros((10_000, 64)) + np.arange(64)
    assert max(len(at) for at, _ in batches.stacks(list(x), batches.phase_space_room)) * 60 * 64 <= batches.ROOM
