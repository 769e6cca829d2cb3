"""Signal steps and families that have no expression form, over stacks of epochs of an Arrow batch.

`register_family` is the hook for further ones: a function of a stack (epochs x samples) and the
sampling rate that returns epochs x values; `each` makes one of a function of a single epoch. A value
that isn't finite, or an epoch for which `each` raises, becomes null for that epoch alone.
"""

from __future__ import annotations

import numpy as np

from . import batches
from .batches import EPS

FAMILIES: dict[str, tuple[list[str], object]] = {}


def register_family(name: str, columns: list[str], fn) -> None:
    FAMILIES[name] = (columns, fn)


def each(fn, n: int):
    """A function of a stack from one of a single epoch that returns n values."""

    def of(stack: np.ndarray, fs: float) -> np.ndarray:
        out = np.full((len(stack), n), np.nan)
        for i, x in enumerate(stack):
            try:
                out[i] = fn(x, fs)
            except (ValueError, FloatingPointError, ZeroDivisionError, np.linalg.LinAlgError):
                pass
        return out

    return of


def family(name: str, x, fs: float):
    """array<double> column of a family's values, in the order of its columns."""
    columns, fn = FAMILIES[name]
    return batches.over(lambda stack: fn(stack, fs), len(columns), x)


def welch_bands(x: np.ndarray, fs: float) -> np.ndarray:
    """Relative delta, theta, alpha, beta power over 0.5-45 Hz, and theta over beta."""
    return batches.band_power(x, fs)[:, :5]


def daubechies(order: int) -> np.ndarray:
    """Scaling filter with `order` vanishing moments: spectral factorisation of the maximally flat half-band filter."""
    from math import comb

    # roots in y of sum C(order - 1 + k, k) y^k, y = (2 - z - 1/z) / 4
    ys = np.roots([comb(order - 1 + k, k) for k in range(order)][::-1])
    h = np.poly(-np.ones(order))
    for y in ys:
        pair = np.roots([1, 4 * y - 2, 1])
        h = np.convolve(h, [1, -pair[np.abs(pair) < 1][0]])
    h = np.real(h)
    return h / h.sum() * np.sqrt(2)


def wavelet_bands(x: np.ndarray, order: int = 4, levels: int = 4) -> list[np.ndarray]:
    """Detail coefficients of each level and the last approximation, of each epoch; ends are mirrored."""
    low = daubechies(order)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    bands, a = [], x
    for _ in range(levels):
        padded = np.pad(a, ((0, 0), (len(low) - 1, len(low) - 1)), mode="symmetric")
        cut = np.lib.stride_tricks.sliding_window_view(padded, len(low), axis=1)[:, 1::2]
        bands.append(cut @ high[::-1])
        a = cut @ low[::-1]
    return [*bands, a]


def wavelet_features(x: np.ndarray, fs: float) -> np.ndarray:
    """Log energy, relative energy and deviation of D1..D4 and A4, and the entropy of the relative energies."""
    bands = wavelet_bands(x)
    e = np.stack([(b**2).sum(1) for b in bands], 1)
    rel = e / np.maximum(e.sum(1, keepdims=True), EPS)
    entropy = -np.where(rel > 0, rel * np.log(np.where(rel > 0, rel, 1)), 0).sum(1)
    return np.column_stack([np.log(e + EPS), rel, *[b.std(1, ddof=1) for b in bands], entropy])


def lempel_ziv(x: np.ndarray, fs: float) -> list[float]:
    """Number of phrases of the median-binarised epoch, times log2(n) / n.

    Each phrase is the shortest run, from where the last one ended, that doesn't occur starting earlier.
    """
    s = "".join("1" if v else "0" for v in x > np.median(x))
    n, at, phrases = len(s), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases += 1
        at += size
    return [phrases * np.log2(n) / n]


def band_pass(fs: float, low: float, high: float, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of second-order sections of a Butterworth band-pass, by the bilinear transform; order is even."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(prototype**2 - w1 * w2)
    s = np.concatenate([prototype + root, prototype - root])
    poles = (2 * fs + s) / (2 * fs - s)
    # all poles are in conjugate pairs, and each pair takes a zero at 0 Hz and one at half the rate
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in poles if p.imag > 0]
    centre = np.exp(2j * np.arctan(np.sqrt(w1 * w2) / (2 * fs)))
    gain = np.prod([abs(np.polyval(n, centre) / np.polyval(d, centre)) for n, d in sections]) ** (-1 / len(sections))
    return [(gain * n, d) for n, d in sections]


def notch(fs: float, at: float, quality: float = 35.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """One second-order section that removes a frequency, with a band of at / quality."""
    w = 2 * np.pi * at / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    return [(gain * np.array([1.0, -2 * np.cos(w), 1.0]), np.array([1.0, -2 * gain * np.cos(w), 2 * gain - 1]))]


def _once(sections, x: np.ndarray) -> np.ndarray:
    """Each epoch through the sections, which start as if its first value had always been there."""
    for n, d in sections:
        first = x[:, 0]
        settled = first * n.sum() / d.sum()
        z2 = n[2] * first - d[2] * settled
        z1 = n[1] * first - d[1] * settled + z2
        y = np.empty_like(x)
        # sample by sample, all epochs at a time
        for t in range(x.shape[1]):
            v = x[:, t]
            y[:, t] = out = n[0] * v + z1
            z1, z2 = n[1] * v - d[1] * out + z2, n[2] * v - d[2] * out
        x = y
    return x


def both_ways(sections, x: np.ndarray, pad: int, start: bool = True, end: bool = True) -> np.ndarray:
    """Each epoch forward and backward through the sections (no phase), with `pad` samples of odd reflection at both ends.

    A part of a longer recording has no reflection at a side where the recording goes on; what is within settling() of that side is
    not what the whole recording has there.
    """
    n = x.shape[1]
    pad = max(0, min(n - 1, pad))
    parts = [2 * x[:, :1] - x[:, pad:0:-1]] * (start and pad > 0), [x], [2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]] * (end and pad > 0)
    y = np.concatenate([p for some in parts for p in some], 1)
    y = _once(sections, _once(sections, y)[:, ::-1])[:, ::-1]
    return y[:, pad * start : pad * start + n]


def settling(sections, tolerance: float = 1e-12) -> int:
    """Samples after which the sections have forgotten their initial state but for that share."""
    slowest = max(abs(r) for _, d in sections for r in np.roots(d))
    # neighbouring poles decay a little slower than each of them
    return int(np.ceil(1.25 * np.log(tolerance) / np.log(slowest)))


def rational(ratio: float, most: int = 1000) -> tuple[int, int]:
    """A ratio of rates as p / q in lowest terms."""
    from fractions import Fraction

    found = Fraction(ratio).limit_denominator(most)
    return found.numerator, found.denominator


def resampling_filter(p: int, q: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Taps of the low-pass for resampling by p / q: a sinc of 2 * half * max(p, q) + 1 taps that is cut off at the lower half rate, under a Kaiser window."""
    most = max(p, q)
    at = np.arange(-half * most, half * most + 1)
    return p / most * np.sinc(at / most) * np.kaiser(len(at), beta)


def polyphase(x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Each epoch at p / q of its rate, ceil(n p / q) samples: zeros go on beyond its ends. Every phase of the filter is one matrix product."""
    if p == q == 1:
        return x
    h = resampling_filter(p, q)
    middle, n = len(h) // 2, x.shape[1]
    n_out = -(-n * p // q)
    taps = -(-len(h) // p)
    padded = np.pad(x, ((0, 0), (taps, taps + middle // p + 1)))
    view = np.lib.stride_tricks.sliding_window_view(padded, taps, axis=1)
    y = np.zeros((len(x), n_out))
    for r in range(min(p, n_out)):
        last, first = divmod(r * q + middle, p)
        own = np.pad(h[first::p], (0, taps - len(h[first::p])))
        count = -(-(n_out - r) // p)
        # windows end at sample last + q t, and the newest sample meets the first tap
        y[:, r::p] = view[:, last + 1 :: q][:, :count] @ own[::-1]
    return y


def cleaned(x: np.ndarray, fs: float, low: float = 0.5, high: float = 45.0, order: int = 4, mains: float = 50.0) -> np.ndarray:
    """Each epoch with mean removed, band-pass and notch without phase."""
    x = both_ways(band_pass(fs, low, min(high, 0.49 * fs), order), x - x.mean(1, keepdims=True), 6 * order)
    return both_ways(notch(fs, mains), x, 6) if mains < fs / 2 else x


def resampled(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """Each epoch at another rate, band-limited below both half rates; for single epochs, whose ends polyphase() would blur."""
    n = int(np.ceil(x.shape[1] * to / fs))
    spectrum = np.fft.rfft(x)
    keep = min(spectrum.shape[1], n // 2 + 1)
    out = np.zeros((len(x), n // 2 + 1), complex)
    out[:, :keep] = spectrum[:, :keep]
    return np.fft.irfft(out, n) * n / x.shape[1]


class Chain:
    """Resampling, band-pass and notch for parts of recordings.

    `halo` input samples on each side of a part (a multiple of q) are enough for the middle to be what the whole recording gives.
    Without low there is no band-pass, and without mains no notch.
    """

    def __init__(self, fs: float, to: float, low: float | None = 0.5, high: float = 45.0, order: int = 4, mains: float | None = 50.0, tolerance: float = 1e-12):
        self.p, self.q = rational(to / fs)
        self.steps = [(band_pass(to, low, min(high, 0.49 * to), order), 6 * order)] if low is not None else []
        if mains is not None and mains < to / 2:
            self.steps.append((notch(to, mains), 6))
        self.lost = [settling(s, tolerance) + pad for s, pad in self.steps]
        #: output samples near an open side that resampling gets wrong
        self.blurred = 0 if self.p == self.q else -(-10 * max(self.p, self.q) // self.q) + 1
        out = sum(self.lost) + self.blurred
        self.halo = (-(-(out * self.q) // self.p) // self.q + 1) * self.q

    def run(self, x: np.ndarray, start: bool, end: bool) -> tuple[np.ndarray, int]:
        """(values, how many are cut off on the left) of a stack of parts, which are the recording's start or end or have more beyond it."""
        y, gone = polyphase(x, self.p, self.q), 0

        def trimmed(y, n):
            return y[:, 0 if start else n : y.shape[1] if end else max(0, y.shape[1] - n)]

        y = trimmed(y, self.blurred)
        gone += 0 if start else self.blurred
        for (sections, pad), n in zip(self.steps, self.lost, strict=True):
            if not y.shape[1]:
                break
            y = trimmed(both_ways(sections, y, pad, start, end), n)
            gone += 0 if start else n
        return y, gone


register_family("welch_bands", ["delta", "theta", "alpha", "beta", "theta_beta"], welch_bands)
register_family("wavelet", [f"{a}_{b}" for a in ("log_energy", "rel_energy", "sd") for b in ("d1", "d2", "d3", "d4", "a4")] + ["entropy"], wavelet_features)
register_family("lempel_ziv", ["complexity"], each(lempel_ziv, 1))
