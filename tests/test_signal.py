import math

import numpy as np
import pytest

from epochlake.functions import batches, signal
from epochlake.operators.statistics import beta_fraction
from epochlake.sources.recordings import decode_bdf


def test_daubechies_filter_is_orthonormal_with_vanishing_moments():
    h = signal.daubechies(4)
    assert len(h) == 8 and h.sum() == pytest.approx(math.sqrt(2)) and (h * h).sum() == pytest.approx(1)
    for shift in (2, 4, 6):
        assert (h[shift:] * h[:-shift]).sum() == pytest.approx(0, abs=1e-9)
    g = h[::-1] * (-1.0) ** np.arange(8)
    for power in range(4):
        assert (g * np.arange(8) ** power).sum() == pytest.approx(0, abs=1e-6)


def test_wavelet_keeps_inner_energy():
    x = np.random.default_rng(0).normal(size=4096)
    e = sum((b**2).sum() for b in signal.wavelet_bands(x[None]))
    assert e == pytest.approx((x**2).sum(), rel=0.05)


def test_welch_finds_the_frequency_and_total_power():
    t = np.arange(1024) / 128
    f, p = batches.welch(np.sin(2 * np.pi * 10 * t)[None], 128)
    assert f[p[0].argmax()] == pytest.approx(10) and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.05)
    assert signal.welch_bands(np.sin(2 * np.pi * 10 * t)[None], 128)[0, 2] > 0.95


def test_filter_keeps_band_and_removes_mains():
    t = np.arange(2560) / 128
    keep, mains, drift = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 50 * t), 5 + 0.05 * t
    y = signal.cleaned((keep + mains + drift)[None], 128)[0, 256:-256]
    assert np.abs(y - keep[256:-256]).max() < 0.05


def plain_filter(b, a, x, state):
    y = []
    for v in x:
        y.append(b[0] * v + state[0])
        state = [b[k + 1] * v - a[k + 1] * y[-1] + (state[k + 1] if k + 2 < len(b) else 0) for k in range(len(b) - 1)]
    return y


def plain_both_ways(b, a, x, pad):
    """Forward and backward through one filter of any order, from steady states that a linear system gives."""
    n = len(b) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -np.array(a[1:])
    companion[:-1, 1:] = np.eye(n - 1)
    start = np.linalg.solve(np.eye(n) - companion, np.array(b[1:]) - np.array(a[1:]) * b[0])
    y = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    for _ in range(2):
        y = plain_filter(b, a, y, list(start * y[0]))[::-1]
    return y[pad : pad + len(x)]


def test_sections_as_one_filter_of_the_whole_order():
    x = np.random.default_rng(3).normal(size=(2, 200)).cumsum(1)
    for sections, pad in ((signal.band_pass(128.0, 2.0, 30.0, 4), 24), (signal.notch(128.0, 50.0), 6)):
        b, a = [1.0], [1.0]
        for n, d in sections:
            b, a = np.convolve(b, n), np.convolve(a, d)
        got = signal.both_ways(sections, x, pad)
        for i in (0, 1):
            assert got[i] == pytest.approx(plain_both_ways(b, a, x[i], pad), abs=1e-6)


def test_band_pass_response():
    f = np.array([0.5, 5.0, 45.0, 60.0, 0.05])
    at = np.exp(2j * np.pi * f / 128)
    gain = np.abs(np.prod([np.polyval(n, at) / np.polyval(d, at) for n, d in signal.band_pass(128.0, 0.5, 45.0, 4)], 0))
    assert gain[[0, 2]] == pytest.approx([math.sqrt(0.5)] * 2, rel=1e-6) and gain[1] == pytest.approx(1, abs=1e-3) and (gain[3:] < 0.1).all()
    (n, d) = signal.notch(128.0, 50.0)[0]
    edge = np.exp(2j * np.pi * 50 / 128), np.exp(1j)
    assert abs(np.polyval(n, edge[0]) / np.polyval(d, edge[0])) < 1e-9 and abs(np.polyval(n, edge[1]) / np.polyval(d, edge[1])) > 0.99


def test_resampling_keeps_a_sine():
    t = np.arange(512) / 256
    y = signal.resampled(np.sin(2 * np.pi * 8 * t)[None], 256, 128)[0]
    assert len(y) == 256 and np.abs(y - np.sin(2 * np.pi * 8 * np.arange(256) / 128)).max() < 1e-6


def brute_phrases(s):
    at = phrases = 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and any(s[i : i + size] == s[at : at + size] for i in range(at)):
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


def test_lempel_ziv_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (4, 20, 64):
        x = rng.normal(size=n)
        s = list(x > np.median(x))
        assert signal.lempel_ziv(x, 1)[0] == pytest.approx(brute_phrases(s) * math.log2(n) / n)


def test_log_covariance_of_white_channels():
    x = np.linalg.qr(np.random.default_rng(2).normal(size=(300, 3)))[0]
    x = (x - x.mean(0)).T
    off = batches.log_covariance((np.linalg.inv(np.linalg.cholesky(np.cov(x))) @ x)[None], "offdiag")
    assert np.abs(off).max() < 1e-9
    assert [batches.log_covariance(x[None], k).shape[1] for k in ("full", "diag", "offdiag", "corr")] == [6, 3, 3, 3]


def test_beta_fraction():
    assert beta_fraction(2, 3, 0.4) == pytest.approx(0.5248)
    assert beta_fraction(5, 0.5, 10 / (10 + 2.2281388519649385**2)) == pytest.approx(0.05)
    assert beta_fraction(0.5, 0.5, 0.5) == pytest.approx(0.5)


def bdf(values, per_record=4, records=None, tail=b"", labels=("Fz", "Cz")):
    n, total = len(labels), len(values[0]) // per_record
    pad = lambda s, w: str(s).ljust(w).encode()
    head = b"\xffBIOSEMI" + pad("", 160) + b"01.01.0101.01.01" + pad(256 * (n + 1), 8) + pad("24BIT", 44) + pad(total if records is None else records, 8) + pad(1, 8) + pad(n, 4)
    columns = [(labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-8388608] * n, 8), ([8388607] * n, 8), ([""] * n, 80), ([per_record] * n, 8), ([""] * n, 32)]
    head += b"".join(pad(v, w) for vs, w in columns for v in vs)
    body = b"".join(int(v).to_bytes(3, "little", signed=True) for r in range(total) for c in values for v in c[r * per_record : (r + 1) * per_record])
    return head + body + tail


def test_bdf_values_negative_and_truncated():
    values = [[0, -1, 8388607, -8388608, 5, 6, 7, 8], [1, 2, 3, 4, -5, -6, -7, -8]]
    gain = 200 / 16777215
    for content in (bdf(values), bdf(values, records=-1), bdf(values, records=9, tail=b"\x01\x02")):
        got = decode_bdf(content, ["cz", "FZ"])
        assert [c for c, _, _ in got] == ["cz", "FZ"] and got[0][1] == 4
        for (_, _, x), want in zip(got, values[::-1], strict=True):
            assert x == pytest.approx([(v + 8388608) * gain - 100 for v in want])


def test_bdf_errors():
    with pytest.raises(ValueError, match="no channel"):
        decode_bdf(bdf([[1] * 4] * 2), ["Oz"])
    with pytest.raises(ValueError, match="not a BDF"):
        decode_bdf(b"x" * 300, ["Fz"])


def test_modes_add_up():
    from epochlake.functions import decompose

    t = np.arange(256) / 128
    x = np.sin(2 * np.pi * 5 * t) + 0.5 * np.sin(2 * np.pi * 30 * t)
    assert np.abs(sum(decompose.empirical_modes(x)) - x).max() < 1e-9
    assert np.abs(sum(decompose.wavelet_modes(x)) - x).max() < 1e-9
    first = decompose.empirical_modes(x)[0]
    assert np.abs(np.fft.rfft(first)).argmax() == 60  # the fast tone comes out first
    modes = decompose.variational_modes(np.stack([x, -x]), k=2)
    assert np.abs(np.fft.rfft(modes)).argmax(2) / 2 == pytest.approx(np.array([[5, 30]] * 2), abs=1)
    assert np.abs(modes.sum(1) - [x, -x])[:, 32:-32].max() < 0.2


def test_spline_goes_through_its_points():
    from epochlake.functions.decompose import spline

    at = np.array([0, 3, 7, 12])
    y = spline(at, np.array([1.0, -2.0, 4.0, 0.0]), 13)
    assert y[at] == pytest.approx([1, -2, 4, 0])


def test_wrapper_searches_find_the_useful_features():
    from epochlake.operators.selection import aquila, grey_wolves

    useful = np.array([True, False, True, False, False])
    losses = lambda masks: np.array([np.mean(m != useful) for m in masks])
    assert (grey_wolves(losses, 5, 10, 15) == useful).mean() >= 0.8
    assert (aquila(losses, 5, 10, 15) == useful).mean() >= 0.8
