"""Features of many epochs at a time: what needs a Fourier transform, all pairs of samples or an eigenvalue
decomposition, as numpy over stacks of equally long epochs of an Arrow batch.

A stack is epochs x samples; a function of it returns epochs x values. `over` makes a column function of one:
an epoch that is null, or holds null or a value that isn't finite, has null values, and so has a value that
comes out as not finite. Where fn raises, only the epochs that make it raise are null. The expressions of `features` say the same where there are both; tests hold them together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

EPS = np.finfo(float).eps
#: Doubles that a function may hold for a part of a stack at a time.
ROOM = 4_000_000

# Delta, theta, alpha and beta bands in Hz, low end in, high end out.
BANDS = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]
TOTAL = (0.5, 45.0)


def stacks(values, room=lambda n: n):
    """(positions, stack) of the complete epochs of a series, by length, in parts with room(n) doubles an epoch."""
    by_length: dict[int, list] = {}
    for i, v in enumerate(values):
        if v is None:
            continue
        v = np.asarray(v, float)
        if v.ndim == 1 and len(v) and np.isfinite(v).all():
            by_length.setdefault(len(v), []).append((i, v))
    for n, found in by_length.items():
        step = max(1, ROOM // max(1, room(n)))
        for k in range(0, len(found), step):
            yield np.array([i for i, _ in found[k : k + step]]), np.stack([v for _, v in found[k : k + step]])


def evaluated(fn, at: np.ndarray, stack: np.ndarray):
    """(positions, values) of a stack; where fn raises, of its halves, so that only the epochs that make it raise are left out."""
    todo = [(at, stack)]
    while todo:
        at, stack = todo.pop()
        try:
            with np.errstate(all="ignore"):
                values = np.asarray(fn(stack), float)
        except (ValueError, FloatingPointError, ZeroDivisionError, np.linalg.LinAlgError):
            if len(at) > 1:
                k = len(at) // 2
                todo += [(at[k:], stack[k:]), (at[:k], stack[:k])]
            continue
        yield at, values


def over(fn, n: int, x, room=lambda n: n):
    """array<double> column of the n values that fn gives for each epoch of column x; n None: as many as come."""

    def run(s: pd.Series) -> pd.Series:
        out = [None if n is None else [None] * n] * len(s)
        for at, values in (part for at, stack in stacks(s, room) for part in evaluated(fn, at, stack)):
            fine = np.isfinite(values)
            for i, v, f in zip(at, values.tolist(), fine, strict=True):
                out[i] = v if f.all() else [a if b else None for a, b in zip(v, f, strict=True)]
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(x)


def named(values, columns: list[str]):
    """A struct of the values of an array column."""
    return F.struct(*[F.get(values, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def z(x: np.ndarray) -> np.ndarray:
    """Each epoch less its mean, over its deviation."""
    return (x - x.mean(1, keepdims=True)) / (x.std(1, ddof=1, keepdims=True) + EPS)


# --- spectra


def welch(x: np.ndarray, fs: float, segment: int = 128, nfft: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density of each epoch): Hamming segments with half overlap; a shorter epoch is one segment."""
    segment = min(segment, x.shape[1])
    nfft = max(nfft, segment)
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(segment) / max(1, segment - 1))
    cut = np.lib.stride_tricks.sliding_window_view(x, segment, axis=1)[:, :: max(1, segment - segment // 2)]
    p = (np.abs(np.fft.rfft(cut * w, nfft, axis=2)) ** 2).mean(1) / (fs * (w**2).sum())
    p[:, 1 : p.shape[1] - (nfft % 2 == 0)] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def area(f: np.ndarray, p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Power from low on and below high, by the trapezoid rule."""
    m = (f >= low) & (f < high)
    return ((p[:, m][:, 1:] + p[:, m][:, :-1]) / 2 * np.diff(f[m])).sum(1)


BAND_COLUMNS = [*[b for b, _, _ in BANDS], "theta_beta", "lv_full", "lv_1_30", "hf_30_45", *[f"log_{b}" for b, _, _ in BANDS]]


def band_power(x: np.ndarray, fs: float) -> np.ndarray:
    """Relative power of each band, theta over beta, log power of 0.5-45, 1-30 and 30-45 Hz, and of each band."""
    f, p = welch(x, fs)
    top = TOTAL[1] + 0.01
    whole, bands = area(f, p, TOTAL[0], top), [area(f, p, low, high) for _, low, high in BANDS]
    rel = [b / np.maximum(whole, EPS) for b in bands]
    logs = [np.log(b + EPS) for b in (whole, area(f, p, 1, 30), area(f, p, 30, top), *bands)]
    return np.stack([*rel, rel[1] / np.maximum(rel[3], EPS), *logs], 1)


def spectral_entropy(x: np.ndarray, fs: float) -> np.ndarray:
    """Entropy of the power of the z-scored epoch in 0.5-45 Hz, over the log of the number of bins."""
    f, p = welch(z(x), fs)
    p = p[:, (f >= TOTAL[0]) & (f <= TOTAL[1])]
    p = p / p.sum(1, keepdims=True)
    return (-np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1) / np.log(p.shape[1]))[:, None]


# --- entropies of all pairs


def _templates(x: np.ndarray, m: int) -> np.ndarray:
    """epochs x (N - m) x m"""
    return np.lib.stride_tricks.sliding_window_view(x, m, axis=1)[:, : x.shape[1] - m]


def _distances(t: np.ndarray) -> np.ndarray:
    """Chebyshev distances of all pairs of templates: epochs x pairs."""
    i, j = np.triu_indices(t.shape[1], 1)
    far = np.zeros((len(t), len(i)))
    for k in range(t.shape[2]):
        np.maximum(far, np.abs(t[:, i, k] - t[:, j, k]), out=far)
    return far


pairs_room = lambda n: 3 * n * n


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> np.ndarray:
    """-log(A / B); each length has its own N - m templates; null where A or B is 0."""
    x = z(x)
    near = r * x.std(1, ddof=1, keepdims=True)
    b, a = ((_distances(_templates(x, k)) <= near).sum(1) for k in (m, m + 1))
    return np.where((a > 0) & (b > 0), -np.log(np.maximum(a, 1) / np.maximum(b, 1)), np.nan)[:, None]


def fuzzy_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, n: int = 2) -> np.ndarray:
    x = z(x)
    near = r * x.std(1, ddof=1, keepdims=True)

    def phi(k):
        t = _templates(x, k)
        count = t.shape[1]
        return 2 * np.exp(-((_distances(t - t.mean(2, keepdims=True)) / near) ** n)).sum(1) / (count * (count - 1))

    a, b = phi(m), phi(m + 1)
    return np.where((a > 0) & (b > 0), np.log(a) - np.log(b), np.nan)[:, None]


# --- scaling exponents


def _slopes(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares slope of each row of y on `at`."""
    away = at - at.mean()
    return ((y - y.mean(1, keepdims=True)) @ away / (away @ away))[:, None]


def _boxes(x: np.ndarray, n: int) -> np.ndarray:
    """epochs x boxes x n: consecutive boxes; an incomplete tail is left out."""
    return x[:, : x.shape[1] // n * n].reshape(len(x), -1, n)


def higuchi(x: np.ndarray, kmax: int = 8) -> np.ndarray:
    """Slope of the log of the mean curve length on that of 1 / k, for steps k of 1 .. kmax."""
    x, n = z(x), x.shape[1]
    lengths = []
    for k in range(1, kmax + 1):
        walks = [np.abs(np.diff(x[:, m::k], axis=1)) for m in range(k)]
        lengths.append(np.mean([w.sum(1) * (n - 1) / (w.shape[1] * k) / k for w in walks if w.shape[1]], 0))
    return _slopes(np.log(1 / np.arange(1, kmax + 1)), np.log(np.stack(lengths, 1)))


def dfa(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Exponent of detrended fluctuation over boxes of the sizes."""
    x = z(x)
    y = np.cumsum(x - x.mean(1, keepdims=True), axis=1)
    logs = []
    for n in sizes:
        t = np.arange(n) - (n - 1) / 2
        b = _boxes(y, n)
        b = b - b.mean(2, keepdims=True)
        rest = b - (b @ t / (t @ t))[..., None] * t
        logs.append(np.log(np.sqrt((rest**2).mean(2).mean(1))))
    return _slopes(np.log(sizes), np.stack(logs, 1))


def hurst(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rescaled-range exponent over segments of the sizes."""
    x = z(x)
    logs = []
    for n in sizes:
        b = _boxes(x, n)
        walk = np.cumsum(b - b.mean(2, keepdims=True), axis=2)
        logs.append(np.log(((walk.max(2) - walk.min(2)) / np.maximum(b.std(2, ddof=1), EPS)).mean(1)))
    return _slopes(np.log(sizes), np.stack(logs, 1))


# --- phase space

PSR2 = ["cem", "tps", "ica", "ism", "iam", "tms", "pdd", "sdd", "ocm", "rda", "sam", "ots", "oam", "bdi", "ecm"]
PSR3 = ["sci", "dem", "tbi", "tti"]


def _whole(x: np.ndarray, tau: int) -> np.ndarray:
    """Which epochs are long and varied enough for an embedding."""
    return (x.shape[1] >= 3 * tau + 4) & (x.std(1, ddof=1) >= 1e-12)


def phase_space_room(n: int) -> int:
    """Doubles that phase-space features take for an epoch of n samples: some 60 arrays of it and the counts of the boxes."""
    return 60 * n + 4 * 8**3


def phase_space(x: np.ndarray, tau: int = 1) -> np.ndarray:
    """The fifteen features of the two-dimensional embedding (x[n], x[n + tau])."""
    if x.shape[1] < 3 * tau + 4:
        return np.full((len(x), len(PSR2)), np.nan)
    p = np.stack([x[:, :-tau], x[:, tau:]], 2)
    a, b = p[..., 0], p[..., 1]
    norm = lambda v: np.sqrt((v * v).sum(2))
    twice = lambda u, v: u[..., 0] * v[..., 1] - v[..., 0] * u[..., 1]

    def turns(v):
        n = norm(v[:, :-1]) * norm(v[:, 1:])
        cos = np.where(n > 1e-12, (v[:, :-1] * v[:, 1:]).sum(2) / np.where(n > 1e-12, n, 1), 1.0)
        return np.arccos(np.clip(cos, -1, 1)).sum(1)

    p1, p2, p3 = p[:, :-2], p[:, 1:-1], p[:, 2:]
    size = 0.5 * np.abs(twice(p2 - p1, p3 - p1))
    s1, s2, s3 = norm(p2 - p1), norm(p3 - p2), norm(p1 - p3)
    around = np.maximum(s1 + s2 + s3, EPS)
    centre = (s2[..., None] * p1 + s3[..., None] * p2 + s1[..., None] * p3) / around[..., None]
    xx, yy, xy = (a * a).mean(1), (b * b).mean(1), (a * b).mean(1)
    spread = np.sqrt(np.maximum((xx + yy) ** 2 - 4 * (xx * yy - xy * xy), 0))
    major, minor = np.sqrt(3 * np.maximum(xx + yy + spread, 0)), np.sqrt(3 * np.maximum(xx + yy - spread, 0))
    u, v = (a - b) / np.sqrt(2), (a + b) / np.sqrt(2)
    steps = (np.diff(p, axis=1) ** 2).sum((1, 2))
    out = np.stack([
        np.pi * steps, size.sum(1), np.pi * ((2 * size / around) ** 2).sum(1), norm(np.diff(centre, axis=1)).sum(1), turns(centre), steps,
        np.abs(u).sum(1), np.abs(v).sum(1), 2 / (1 + np.sqrt(2)) * major * major, norm(p).sum(1), turns(p),
        0.5 * np.abs(twice(p[:, :-1], p[:, 1:])).sum(1), np.abs(u * v).sum(1), np.pi * u.std(1, ddof=1) * v.std(1, ddof=1), np.pi * major * minor,
    ], 1)
    out[~_whole(x, tau)] = np.nan
    return out


def phase_space_3d(x: np.ndarray, tau: int = 1, bins: int = 8, horizon: int = 10) -> np.ndarray:
    """sci, dem, tbi, tti of the three-dimensional embedding. sci is the exponential of an entropy in bits."""
    if x.shape[1] < 3 * tau + 4:
        return np.full((len(x), len(PSR3)), np.nan)
    m = x.shape[1] - 2 * tau
    q = np.stack([x[:, k * tau : k * tau + m] for k in range(3)], 2)
    low, high = q.min(1, keepdims=True), q.max(1, keepdims=True)
    cell = np.minimum(np.floor((q - low) / np.maximum(high - low, EPS) * bins), bins - 1).astype(int) @ np.array([bins * bins, bins, 1])
    counts = np.bincount((cell + bins**3 * np.arange(len(x))[:, None]).ravel(), minlength=len(x) * bins**3).reshape(len(x), -1) / m
    sci = np.exp(-np.where(counts > 0, counts * np.log2(np.where(counts > 0, counts, 1)), 0).sum(1))
    norm = lambda v: np.sqrt((v * v).sum(2))
    far = [np.log(norm(q[:, k:] - q[:, :-k]).mean(1) + EPS) for k in range(1, horizon + 1) if k <= m - 2]
    # first, second and third differences, cut to the length of the third
    d1, d2, d3 = (np.diff(q, k, axis=1)[:, : m - 3] for k in (1, 2, 3))
    turn = np.cross(d1, d2)
    n1, n2 = norm(d1), norm(turn)
    mean = lambda v, keep: np.where(keep, v, 0).sum(1) / keep.sum(1)
    bent, twisted = n1 > 1e-9, n2 > 1e-9
    tbi = mean(n2 / np.where(bent, n1, 1) ** 3, bent)
    tti = np.where(twisted.any(1), mean((d1 * np.cross(d2, d3)).sum(2) / np.where(twisted, n2, 1) ** 2, twisted), 0.0)
    out = np.stack([sci, np.mean(far, 0), tbi, tti], 1)
    out[~_whole(x, tau)] = np.nan
    return out


# --- covariance


def log_covariance(stack: np.ndarray, kind: str = "full", shrink: float = 1e-3) -> np.ndarray:
    """Upper triangle, column by column, of the matrix logarithm of the channels' covariance, off-diagonals times sqrt(2).

    stack: epochs x channels x samples. The covariance is shrunk by shrink * trace / channels.
    kind: full, diag, offdiag, or corr (the correlation matrix without its diagonal).
    """
    n = stack.shape[1]
    away = stack - stack.mean(2, keepdims=True)
    c = away @ away.transpose(0, 2, 1) / (stack.shape[2] - 1)
    c = c + shrink * np.trace(c, axis1=1, axis2=2)[:, None, None] / n * np.eye(n)
    if kind == "corr":
        d = np.sqrt(np.einsum("eii->ei", c))
        c = c / (d[:, :, None] * d[:, None, :]) + shrink * np.eye(n)
    values, vectors = np.linalg.eigh(c)
    m = (vectors * np.log(np.maximum(values, EPS))[:, None, :]) @ vectors.transpose(0, 2, 1)
    rows, cols = np.tril_indices(n)
    flat = m[:, cols, rows] * np.where(rows == cols, 1.0, np.sqrt(2))
    return flat[:, rows == cols] if kind == "diag" else flat if kind == "full" else flat[:, rows != cols]


def log_covariances(x, kind: str):
    """array<double> column of an array<array<double>> column, channels x samples. A channel that is null or holds what
    isn't finite is left out and its cells are null; all are with fewer than two good channels."""

    def run(s: pd.Series) -> pd.Series:
        out: list = [None] * len(s)
        alike: dict[tuple, list] = {}
        for i, v in enumerate(s):
            if v is None:
                continue
            channels = [None if c is None else np.asarray(c, float) for c in v]
            good = tuple(c is not None and len(c) > 1 and bool(np.isfinite(c).all()) for c in channels)
            n = len(channels)
            cells = {"full": n * (n + 1) // 2, "diag": n}.get(kind, n * (n - 1) // 2)
            out[i] = [None] * cells
            kept = [c for c, g in zip(channels, good, strict=True) if g]
            if len(kept) >= 2 and len({len(c) for c in kept}) == 1:
                alike.setdefault((good, len(kept[0])), []).append((i, kept))
        for (good, _), found in alike.items():
            rows, cols = np.tril_indices(len(good))
            own = np.array(good)
            keep = own[rows] & own[cols]
            pick = np.ones(len(rows), bool) if kind == "full" else rows == cols if kind == "diag" else rows != cols
            at = np.flatnonzero(keep[pick])
            for (i, _), values in zip(found, log_covariance(np.array([c for _, c in found]), kind), strict=True):
                for k, a in zip(at, values, strict=True):
                    out[i][k] = float(a) if np.isfinite(a) else None
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(x)
