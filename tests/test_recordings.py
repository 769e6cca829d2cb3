"""Filters and resampling over chunks of recordings against one pass over each recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.functions import signal
from epochlake.operators import recordings


def one_pass(x, fs, to, seconds):
    """The same steps over the whole recording at once."""
    y = signal.polyphase((x - x.mean())[None], *signal.rational(to / fs))
    y = signal.both_ways(signal.band_pass(to, 0.5, min(45.0, 0.49 * to), 4), y, 24)
    if 50 < to / 2:
        y = signal.both_ways(signal.notch(to, 50.0), y, 6)
    n = round(to * seconds)
    return y[0, : y.shape[1] // n * n].reshape(-1, n)


def plain_resampled(x, p, q):
    """By the definition: zeros put in, low-pass, every q-th sample."""
    up = np.zeros(len(x) * p)
    up[::p] = x
    h = signal.resampling_filter(p, q)
    y = np.convolve(up, h)[len(h) // 2 :]
    n = -(-len(x) * p // q)
    return np.pad(y, (0, max(0, n * q - len(y))))[: n * q : q]


@pytest.mark.parametrize(("p", "q"), [(1, 1), (1, 2), (2, 1), (3, 2), (2, 3), (64, 125), (7, 3)])
def test_polyphase_is_the_definition(p, q):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 333):
        x = r.normal(size=(2, n))
        y = signal.polyphase(x, p, q)
        for a, b in zip(x, y, strict=True):
            assert b == pytest.approx(plain_resampled(a, p, q) if p != q else a, abs=1e-12)


def test_resampling_keeps_a_tone_and_removes_what_would_fold():
    t = np.arange(5120) / 512
    tone, high = np.sin(2 * np.pi * 9 * t), np.sin(2 * np.pi * 190 * t)
    y = signal.polyphase((tone + high)[None], *signal.rational(128 / 512))[0]
    want = np.sin(2 * np.pi * 9 * np.arange(len(y)) / 128)
    assert np.abs(y - want)[64:-64].max() < 2e-3


# chunks far shorter than the settling of the filter, and longer ones
@pytest.mark.parametrize(("fs", "to", "chunk"), [(128.0, 128.0, 40.0), (256.0, 128.0, 9.0), (200.0, 128.0, 9.0), (64.0, 128.0, 40.0)])
def test_chunks_equal_one_pass(spark, fs, to, chunk):
    r = np.random.default_rng(4)
    lengths = {"long": 20_011, "short": 700, "tiny": 30, "even": 16_000, "one": 1}
    x = {k: np.cumsum(r.normal(size=n)) * 0.3 + r.normal(size=n) * 20 + 500 for k, n in lengths.items()}
    size = 900
    rows = [(k, s, v[s : s + size].tolist()) for k, v in x.items() for s in range(0, len(v), size)]
    parts = spark.createDataFrame(rows, "who string, start long, x array<double>").repartition(5)
    got = recordings.filtered_epochs(parts, ["who"], fs, to, 2.0, chunk_seconds=chunk).collect()
    for k, v in x.items():
        mine = sorted((e["epoch"], e["x"]) for e in got if e["who"] == k)
        want = one_pass(v, fs, to, 2.0)
        assert [e for e, _ in mine] == list(range(len(want)))
        if len(want):
            assert np.abs(np.array([e for _, e in mine]) - want).max() < 1e-9 * np.abs(v).max()


def test_rows_become_segments_and_bad_recordings_have_no_epochs(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=2000)
    rows = [("good", i, float(v)) for i, v in enumerate(x)] + [("gap", i, float(v) if i != 700 else None) for i, v in enumerate(x)] + [("nan", i, float("nan") if i == 5 else 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "who string, at int, v double").orderBy(F.rand(1))
    parts = recordings.segments(df, ["who"], ["at"], "v", 256)
    got = recordings.filtered_epochs(parts, ["who"], 128.0, 128.0, 1.0, chunk_seconds=5.0).collect()
    assert {e["who"] for e in got} == {"good"}
    want = one_pass(x, 128.0, 128.0, 1.0)
    assert np.abs(np.array([e["x"] for e in sorted(got, key=lambda e: e["epoch"])]) - want).max() < 1e-9
    lost = parts.filter("who = 'good' AND start <> 512")
    assert recordings.filtered_epochs(lost, ["who"], 128.0, 128.0, 1.0).count() == 0


def test_an_empty_table(spark):
    parts = spark.createDataFrame([], "who string, start long, x array<double>")
    assert recordings.filtered_epochs(parts, ["who"], 128.0, 64.0, 1.0).collect() == []
