"""Decomposition of an epoch into modes, from the published methods; checked by reconstruction, not by equality.

A mode is an array, so what follows (phase-space, band or time-domain features) is
array expressions again: `modes` gives a row for each mode of each epoch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, signal
from .batches import EPS

#: Values of modes that a batch may hold.
MODE_ROOM = 262_144


def spline(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Natural cubic spline through (at, values), at 0 .. n - 1."""
    h = np.diff(at).astype(float)
    m = np.zeros(len(at))
    if len(at) > 2:
        d = np.diff(values) / h
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(d))
    x = np.arange(n)
    k = np.clip(np.searchsorted(at, x, "right") - 1, 0, len(h) - 1)
    u, w = x - at[k], at[k + 1] - x
    return (m[k] * w**3 + m[k + 1] * u**3) / (6 * h[k]) + (values[k] / h[k] - m[k] * h[k] / 6) * w + (values[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def _envelope(x: np.ndarray, sign: int) -> np.ndarray | None:
    """Spline over the maxima (sign 1) or minima (-1), which are mirrored at the ends."""
    y = sign * x
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    if len(at) < 2:
        return None
    n = len(x)
    left, right = at[:2][::-1], at[-2:][::-1]
    points = np.concatenate([-left, at, 2 * (n - 1) - right])
    heights = np.concatenate([x[left], x[at], x[right]])
    keep = np.concatenate([[True], np.diff(points) > 0])
    points, heights = points[keep], heights[keep]
    shift = points[0]
    return spline(points - shift, heights, n - shift)[-shift:][:n]


def empirical_modes(x: np.ndarray, most: int = 4, sifts: int = 50, tolerance: float = 0.2) -> list[np.ndarray]:
    """Intrinsic mode functions by sifting, at most `most`, and the residue last; they add up to x."""
    out, rest = [], x.astype(float)
    while len(out) < most:
        h = rest.copy()
        for _ in range(sifts):
            high, low = _envelope(h, 1), _envelope(h, -1)
            if high is None or low is None:
                break
            new = h - (high + low) / 2
            moved = ((h - new) ** 2).sum() / max((h**2).sum(), 1e-300)
            h = new
            if moved < tolerance / 10:
                break
        if _envelope(rest, 1) is None or _envelope(rest, -1) is None:
            break
        out.append(h)
        rest = rest - h
    return [*out, rest]


def wavelet_modes(x: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """Empirical wavelet modes: the spectrum is cut at the least value between its n largest peaks, with smooth edges."""
    s = np.fft.rfft(x)
    p = np.abs(s)
    peaks = np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] >= p[2:])) + 1
    top = np.sort(peaks[np.argsort(-p[peaks], kind="stable")[:n]])
    cuts = [a + int(p[a : b + 1].argmin()) for a, b in zip(top, top[1:], strict=False)]
    f, out, below = np.arange(len(s)), [], np.zeros(len(s))
    for c in [*cuts, None]:
        # share of each frequency below the cut, from 1 to 0 over a tenth of the cut
        w = np.ones(len(s)) if c is None else np.clip((c * 1.1 + 0.5 - f) / max(0.2 * c, 1.0), 0, 1)
        out.append(np.fft.irfft(s * (w - below), len(x)))
        below = w
    return out


# --- the same over stacks: splines of all epochs are solved together, and epochs that are done are left as they are


def splines(at: np.ndarray, values: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Natural cubic splines at 0 .. n - 1, one for each row: the first count knots of a row of at, the first below 0 and the last beyond n - 1."""
    rows, most = at.shape
    h = np.diff(at, axis=1)
    inner = np.arange(1, most - 1)[None] < count[:, None] - 1
    slope = np.diff(values, axis=1) / h
    # second derivatives by elimination, all rows at a time; a row's own end has none
    right, off = 6 * np.diff(slope, axis=1), np.where(inner, h[:, 1:], 0)
    diagonal = np.where(inner, 2 * (h[:, :-1] + h[:, 1:]), 1.0)
    right = np.where(inner, right, 0)
    upper, reduced = np.zeros_like(right), np.zeros_like(right)
    for i in range(most - 2):
        below = np.where(inner[:, i], h[:, i], 0) if i else 0.0
        pivot = diagonal[:, i] - (below * upper[:, i - 1] if i else 0.0)
        upper[:, i] = off[:, i] / pivot
        reduced[:, i] = (right[:, i] - (below * reduced[:, i - 1] if i else 0.0)) / pivot
    m = np.zeros((rows, most))
    for i in range(most - 3, -1, -1):
        following = m[:, i + 2] if i < most - 3 else 0.0
        m[:, i + 1] = np.where(inner[:, i], reduced[:, i] - upper[:, i] * following, 0)
    # which knot stands before each sample
    marks = np.zeros((rows, n + 1), np.int64)
    known = np.arange(most)[None] < count[:, None]
    r, c = np.nonzero(known)
    np.add.at(marks, (r, np.clip(at[r, c], 0, n).astype(np.int64)), 1)
    k = np.minimum(np.cumsum(marks[:, :n], 1) - 1, count[:, None] - 2)
    take = lambda a, j: np.take_along_axis(a, j, 1)
    width, u = take(h, k), np.arange(n) - take(at, k)
    w = take(at, k + 1) - np.arange(n)
    return (take(m, k) * w**3 + take(m, k + 1) * u**3) / (6 * width) + (take(values, k) / width - take(m, k) * width / 6) * w + (take(values, k + 1) / width - take(m, k + 1) * width / 6) * u


def extrema(x: np.ndarray, sign: int) -> np.ndarray:
    """Where each epoch has a maximum (sign 1) or minimum (-1)."""
    y = sign * x
    out = np.zeros(x.shape, bool)
    out[:, 1:-1] = (y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] >= y[:, 2:])
    return out


def envelopes(x: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """(has one, values) of each epoch: _envelope() of a stack."""
    n, there = x.shape[1], extrema(x, sign)
    count = there.sum(1)
    fine = count >= 2
    out = np.zeros(x.shape)
    rows = np.flatnonzero(fine)
    if not len(rows):
        return fine, out
    r, c = np.nonzero(there[rows])
    count = count[rows]
    place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
    # beyond a row's own knots come further ones, which it doesn't use
    at = np.cumsum(np.ones((len(rows), count.max() + 4)), 1) + 4.0 * n
    heights = np.zeros(at.shape)
    at[r, place + 2], heights[r, place + 2] = c, x[rows][r, c]
    every = np.arange(len(rows))
    for knot, source, mirror in ((0, 3, 0), (1, 2, 0), (count + 2, count + 1, 2 * (n - 1)), (count + 3, count, 2 * (n - 1))):
        at[every, knot], heights[every, knot] = mirror - at[every, source], heights[every, source]
    out[rows] = splines(at, heights, count + 4, n)
    return fine, out


def empirical_stack(x: np.ndarray, most: int = 4, sifts: int = 50, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epochs x most x samples, which modes an epoch has, residue): empirical_modes() of a stack."""
    rest, going = x.astype(float).copy(), np.arange(len(x))
    out, has = np.zeros((len(x), most, x.shape[1])), np.zeros((len(x), most), bool)
    for k in range(most):
        # an epoch without two maxima and two minima is done
        going = going[(extrema(rest[going], 1).sum(1) >= 2) & (extrema(rest[going], -1).sum(1) >= 2)]
        if not len(going):
            break
        h, live = rest[going].copy(), np.arange(len(going))
        for _ in range(sifts):
            (a, high), (b, low) = envelopes(h[live], 1), envelopes(h[live], -1)
            both = a & b
            live = live[both]
            new = h[live] - (high[both] + low[both]) / 2
            moved = ((h[live] - new) ** 2).sum(1) / np.maximum((h[live] ** 2).sum(1), 1e-300)
            h[live] = new
            live = live[moved >= tolerance / 10]
            if not len(live):
                break
        out[going, k], has[going, k] = h, True
        rest[going] -= h
    return out, has, rest


def wavelet_stack(x: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(epochs x n x samples, which modes an epoch has): wavelet_modes() of a stack."""
    s = np.fft.rfft(x, axis=1)
    p = np.abs(s)
    peaks = extrema(p, 1)
    count = np.minimum(peaks.sum(1), n)
    order = np.argsort(np.where(peaks, -p, np.inf), axis=1, kind="stable")[:, :n]
    order = np.pad(order, ((0, 0), (0, n - order.shape[1])))
    top = np.sort(np.where(np.arange(n)[None] < count[:, None], order, p.shape[1]), axis=1)
    f = np.arange(p.shape[1])[None]
    out, has, below = np.zeros((len(x), n, x.shape[1])), np.zeros((len(x), n), bool), np.zeros(p.shape)
    for k in range(n):
        present = (k < count) | (k == 0)
        last = k + 1 >= count
        w = np.ones(p.shape)
        if k + 1 < n:
            a, b = top[:, k : k + 1], top[:, k + 1 : k + 2]
            cut = np.where((f >= a) & (f <= b), p, np.inf).argmin(1)[:, None]
            w = np.where(last[:, None], 1.0, np.clip((cut * 1.1 + 0.5 - f) / np.maximum(0.2 * cut, 1.0), 0, 1))
        out[:, k] = np.where(present[:, None], np.fft.irfft(s * (w - below), x.shape[1], axis=1), 0)
        has[:, k], below = present, w
    return out, has


def variational_modes(x: np.ndarray, k: int = 4, alpha: float = 2000.0, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """epochs x modes x samples, in rising order of their centre: alternate Wiener filters and centre frequencies of k modes.

    An epoch whose modes have settled is left as it is while the others of the stack go on.
    """
    n = x.shape[1]
    half = n // 2
    y = np.concatenate([x[:, :half][:, ::-1], x, x[:, n - half :][:, ::-1]], 1)
    s, f = np.fft.rfft(y), np.fft.rfftfreq(y.shape[1])
    u = np.zeros((len(x), k, s.shape[1]), complex)
    w = np.tile(0.5 * (np.arange(k) + 0.5) / k, (len(x), 1))
    live = np.arange(len(x))
    for _ in range(rounds):
        before, now = u[live], u[live].copy()
        for i in range(k):
            now[:, i] = (s[live] - now.sum(1) + now[:, i]) / (1 + 2 * alpha * (f - w[live, i][:, None]) ** 2)
            e = np.abs(now[:, i]) ** 2
            w[live, i] = (f * e).sum(1) / np.maximum(e.sum(1), 1e-300)
        u[live] = now
        moved = (np.abs(now - before) ** 2).sum((1, 2)) / np.maximum((np.abs(before) ** 2).sum((1, 2)), 1e-300)
        live = live[moved >= tolerance]
        if not len(live):
            break
    order = np.argsort(w, axis=1, kind="stable")
    return np.fft.irfft(np.take_along_axis(u, order[:, :, None], 1), y.shape[1])[..., half : half + n]


def variational_features(x: np.ndarray, fs: float) -> np.ndarray:
    """Of z-scored epochs, for each of four modes: log energy, relative energy, mobility, and Welch centroid in Hz."""
    modes = variational_modes(batches.z(x))
    e = (modes**2).sum(2)
    mobility = np.sqrt(np.diff(modes, axis=2).var(2, ddof=1) / np.maximum(modes.var(2, ddof=1), EPS))
    f, p = batches.welch(modes.reshape(-1, modes.shape[2]), fs)
    centroid = ((f * p).sum(1) / np.maximum(p.sum(1), EPS)).reshape(len(x), -1)
    return np.stack([np.log(e + EPS), e / np.maximum(e.sum(1, keepdims=True), EPS), mobility, centroid], 2).reshape(len(x), -1)


signal.register_family("variational", [f"m{k}_{a}" for k in range(1, 5) for a in ("log_energy", "rel_energy", "mobility", "centroid")], variational_features)


def modes(epochs: DataFrame, keys: list[str], x: str = "x", imfs: int = 4, per_imf: int = 2) -> DataFrame:
    """(keys, imf, mode, x): empirical wavelet modes of the intrinsic modes of z-scored epochs.

    A mode that an epoch hasn't, or all of an epoch that can't be split, have null for x, so every epoch has a row for each mode.
    """

    import pyarrow as pa

    every = [(i, j) for i in range(imfs) for j in range(per_imf)]

    def split(part):
        """An Arrow batch of the modes of a part of a batch, which numpy holds and no Python object for each value."""
        values = part.column(x).to_pylist()
        found: list[tuple] = []  # (places in the part, place of the mode, stack)
        # an epoch's modes and the splines on the way to them
        for at, stack in batches.stacks(values, lambda n: (imfs * per_imf + 12) * n):
            modes_, there, _ = empirical_stack(batches.z(stack), imfs)
            for i in range(imfs):
                rows = np.flatnonzero(there[:, i])
                if len(rows):
                    parts, has = wavelet_stack(modes_[rows, i], per_imf)
                    for j in range(per_imf):
                        fine = has[:, j] & np.isfinite(parts[:, j]).all(1)
                        found.append((at[rows[fine]], i * per_imf + j, parts[fine, j]))
        # where each mode is among the stacks, one after another
        ends = np.cumsum([0, *[m.size for *_, m in found]])
        length, start = np.zeros((len(values), len(every)), np.int64), np.zeros((len(values), len(every)), np.int64)
        for (at, k, m), first in zip(found, ends, strict=False):
            length[at, k], start[at, k] = m.shape[1], first + np.arange(len(m)) * m.shape[1]
        length, start = length.ravel(), start.ravel()
        flat = np.concatenate([m.ravel() for *_, m in found] or [np.empty(0)])
        offsets = np.concatenate([[0], np.cumsum(length)])
        flat = flat[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(length == 0))
        rows = pa.array(np.repeat(np.arange(len(values)), len(every)))
        imf, mode = (pa.array(np.tile([e[c] + 1 for e in every], len(values)), pa.int32()) for c in (0, 1))
        return pa.RecordBatch.from_arrays([*[part.column(c).take(rows) for c in keys], imf, mode, lists], [*keys, "imf", "mode", "x"])

    def run(arrow):
        for b in arrow:
            # parts of about as many values as a function may hold, by the batch's mean; a long epoch alone
            size = max(1, len(b.column(x).flatten()) // max(1, b.num_rows))
            step = max(1, MODE_ROOM // (size * len(every)))
            for s in range(0, b.num_rows, step):
                yield split(b.slice(s, step))

    out = T.StructType([*epochs.select(*keys).schema, T.StructField("imf", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return epochs.select(*keys, F.col(x).cast("array<double>").alias(x)).mapInArrow(run, out)
