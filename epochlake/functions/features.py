"""Features of one epoch of one channel, as expressions on an array<double> column.

All of them stay inside the JVM: no shuffle and no Python worker, so an epoch
store of any size is one scan. Undefined values are null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import EPS, diff, indices, let, mean, pairs, slope, total, variance, z_scored


def log_variance(x: Column) -> Column:
    return F.ln(variance(x) + F.lit(EPS))


def time_domain(x: Column) -> Column:
    """Struct: logvar, mobility, complexity, skewness, kurtosis, zero_cross, line_length."""

    def of(v0, v1, v2, m, d):
        mobility = F.sqrt(v1 / F.greatest(v0, F.lit(EPS)))
        m2 = mean(x, lambda v: (v - m) * (v - m))
        third = mean(x, lambda v: (v - m) * (v - m) * (v - m))
        fourth = mean(x, lambda v: (v - m) * (v - m) * (v - m) * (v - m))
        return F.struct(
            F.ln(v0 + F.lit(EPS)).alias("logvar"),
            mobility.alias("mobility"),
            (F.sqrt(v2 / F.greatest(v1, F.lit(EPS))) / F.greatest(mobility, F.lit(EPS))).alias("complexity"),
            let(m2, lambda s: F.when(s > 0, third / F.pow(s, F.lit(1.5)))).alias("skewness"),
            let(m2, lambda s: F.when(s > 0, fourth / (s * s))).alias("kurtosis"),
            mean(pairs(x, lambda p, q: (F.signum(p) != F.signum(q)).cast("double"))).alias("zero_cross"),
            mean(d, lambda v: F.abs(v)).alias("line_length"),
        )

    return let(diff(x), lambda d: let(variance(x), lambda v0: let(variance(d), lambda v1: let(variance(diff(d)), lambda v2: let(mean(x), lambda m: of(v0, v1, v2, m, d))))))


def permutation_entropy(x: Column, m: int) -> Column:
    """Entropy of the ordinal patterns of m samples (ties keep their order), over log(m!)."""

    def code(i):
        bits = [F.when(F.get(x, i + a) > F.get(x, i + b), F.lit(2**k)).otherwise(F.lit(0)) for k, (a, b) in enumerate((a, b) for a in range(m) for b in range(a + 1, m))]
        return sum(bits, F.lit(0))

    def entropy(codes):
        share = lambda c: (F.size(codes) - F.size(F.array_remove(codes, c))).cast("double") / F.size(codes)
        return total(F.transform(F.array_distinct(codes), share), lambda p: -p * F.ln(p)) / math.log(math.factorial(m))

    return let(F.transform(indices(F.size(x) - (m - 1)), code), entropy)


def _templates(x: Column, m: int, centred: bool) -> Column:
    """Arrays of m samples from each of the first N - m positions."""
    cut = lambda i: F.slice(x, i + 1, F.lit(m))
    if centred:
        return F.transform(indices(F.size(x) - m), lambda i: let(cut(i), lambda t: let(mean(t), lambda c: F.transform(t, lambda v: v - c))))
    return F.transform(indices(F.size(x) - m), cut)


def _chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def _over_pairs(templates: Column, f) -> Column:
    """Sum of f(distance) over unordered pairs of templates."""
    later = lambda i: F.slice(templates, i + 2, F.size(templates))
    return total(F.transform(templates, lambda a, i: total(F.transform(later(i), lambda b: f(_chebyshev(a, b))))))


def sample_entropy(x: Column, m: int = 2, r: float = 0.2) -> Column:
    """-log(A / B); each length has its own N - m templates; null where A or B is 0."""

    def of(z):
        tolerance = r * F.sqrt(variance(z))
        matches = lambda k: let(tolerance, lambda t: let(_templates(z, k, False), lambda ts: _over_pairs(ts, lambda d: (d <= t).cast("double"))))
        return let(matches(m), lambda b: let(matches(m + 1), lambda a: F.when((a > 0) & (b > 0), -F.ln(a / b))))

    return let(z_scored(x), of)


def fuzzy_entropy(x: Column, m: int = 2, r: float = 0.2, n: int = 2) -> Column:
    def of(z):
        tolerance = r * F.sqrt(variance(z))

        def phi(k):
            similar = lambda t: lambda d: F.exp(-F.pow(d / t, F.lit(float(n))))
            count = (F.size(z) - k).cast("double")
            return let(tolerance, lambda t: let(_templates(z, k, True), lambda ts: F.when(t > 0, 2 * _over_pairs(ts, similar(t)) / (count * (count - 1)))))

        return let(phi(m), lambda a: let(phi(m + 1), lambda b: F.when((a > 0) & (b > 0), F.ln(a) - F.ln(b))))

    return let(z_scored(x), of)


def katz(x: Column) -> Column:
    def of(z):
        n = F.size(z) - 1
        length = total(diff(z), lambda d: F.sqrt(1 + d * d))
        far = F.array_max(F.transform(z, lambda v, i: F.sqrt(i * i + (v - F.get(z, F.lit(0))) * (v - F.get(z, F.lit(0))))))
        return F.log10(n) / (F.log10(n) + F.log10(far / length))

    return let(z_scored(x), of)


def petrosian(x: Column) -> Column:
    n = F.size(x)
    turns = total(pairs(diff(x), lambda p, q: (F.signum(p) != F.signum(q)).cast("double")))
    return let(turns, lambda k: F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * k))))


def higuchi(x: Column, kmax: int = 8) -> Column:
    def of(z):
        n = F.size(z)

        def length(k, m):
            steps = F.floor((n - 1 - m) / F.lit(k))
            walk = total(F.transform(indices(steps), lambda j: F.abs(F.get(z, (j + 1) * k + m) - F.get(z, j * k + m))))
            return F.when(steps >= 1, walk * (n - 1) / (steps * k) / k)

        lk = [F.ln(let(F.filter(F.array(*[length(k, m) for m in range(k)]), lambda v: v.isNotNull()), lambda a: mean(a))) for k in range(1, kmax + 1)]
        return slope(F.array(*[F.lit(math.log(1 / k)) for k in range(1, kmax + 1)]), F.array(*lk))

    return let(z_scored(x), of)


def boxes(low: float, high: float, count: int) -> list[int]:
    """Distinct whole sizes, evenly spaced on a log scale."""
    return sorted({math.floor(low * (high / low) ** (i / (count - 1)) + 0.5) for i in range(count)})


def _segments(y: Column, n: int) -> Column:
    return F.transform(indices(F.floor(F.size(y) / F.lit(n))), lambda i: F.slice(y, i * n + 1, F.lit(n)))


def _running(y: Column) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(y, start, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + v)))


def dfa(x: Column, sizes: list[int]) -> Column:
    """Exponent of detrended fluctuation over boxes of the sizes."""

    def residual(seg, n):
        ts = [float(t + 1) for t in range(n)]
        mt, st = sum(ts) / n, sum((t - (n + 1) / 2) ** 2 for t in ts)
        times = F.array(*map(F.lit, ts))

        def of(my):
            return let(total(F.zip_with(times, seg, lambda t, v: (t - mt) * (v - my))) / st, lambda b: total(F.zip_with(times, seg, lambda t, v: F.pow(v - my - b * (t - mt), F.lit(2.0)))) / n)

        return let(mean(seg), of)

    # a function of one argument: a second one would be given the index
    boxed = lambda n: lambda seg: residual(seg, n)

    def of(y):
        fluctuation = [F.ln(F.sqrt(mean(F.transform(_segments(y, n), boxed(n))))) for n in sizes]
        return slope(F.array(*[F.lit(math.log(n)) for n in sizes]), F.array(*fluctuation))

    return let(z_scored(x), lambda z: let(mean(z), lambda m: let(_running(F.transform(z, lambda v: v - m)), of)))


def hurst(x: Column, sizes: list[int]) -> Column:
    """Rescaled-range exponent over segments of the sizes."""

    def ratio(seg):
        walk = let(mean(seg), lambda m: _running(F.transform(seg, lambda v: v - m)))
        return let(walk, lambda w: (F.array_max(w) - F.array_min(w)) / F.greatest(F.sqrt(variance(seg)), F.lit(EPS)))

    def of(z):
        rs = [F.ln(mean(F.transform(_segments(z, n), ratio))) for n in sizes]
        return slope(F.array(*[F.lit(math.log(n)) for n in sizes]), F.array(*rs))

    return let(z_scored(x), of)


def phase_space(x: Column, tau: int = 1) -> Column:
    """Struct of the fifteen features of the two-dimensional embedding (x[n], x[n + tau]).

    Null where the epoch is shorter than 3 tau + 4 or constant.
    """
    xy = pairs(x, lambda p, q: F.struct(p.alias("x"), q.alias("y")), tau)
    dist = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)))

    def angle(p, q):
        norm = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) * F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        return let(norm, lambda n: F.when(n > 1e-12, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p["x"] * q["x"] + p["y"] * q["y"]) / n)))).otherwise(F.lit(0.0)))

    def triangle(p, q, r):
        def of(a, b, c, area):
            around = F.greatest(a + b + c, F.lit(EPS))
            return F.struct(
                area.alias("area"), (2 * area / around).alias("radius"),
                ((b * p["x"] + c * q["x"] + a * r["x"]) / around).alias("x"), ((b * p["y"] + c * q["y"] + a * r["y"]) / around).alias("y"),
            )

        area = 0.5 * F.abs(p["x"] * (q["y"] - r["y"]) + q["x"] * (r["y"] - p["y"]) + r["x"] * (p["y"] - q["y"]))
        return let(dist(p, q), lambda a: let(dist(q, r), lambda b: let(dist(r, p), lambda c: let(area, lambda s: of(a, b, c, s)))))

    def of(p, tri, sxx, syy, sxy):
        spread = F.sqrt(F.greatest(F.pow(sxx + syy, F.lit(2.0)) - 4 * (sxx * syy - sxy * sxy), F.lit(0.0)))
        major, minor = F.sqrt(3 * F.greatest(sxx + syy + spread, F.lit(0.0))), F.sqrt(3 * F.greatest(sxx + syy - spread, F.lit(0.0)))
        u, v = F.transform(p, lambda q: (q["x"] - q["y"]) / math.sqrt(2)), F.transform(p, lambda q: (q["x"] + q["y"]) / math.sqrt(2))
        steps = total(pairs(p, lambda a, b: F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))))
        return F.struct(
            (math.pi * steps).alias("cem"), total(tri, lambda t: t["area"]).alias("tps"), (math.pi * total(tri, lambda t: t["radius"] * t["radius"])).alias("ica"),
            total(pairs(tri, dist)).alias("ism"), total(pairs(tri, angle)).alias("iam"), steps.alias("tms"),
            total(u, lambda w: F.abs(w)).alias("pdd"), total(v, lambda w: F.abs(w)).alias("sdd"), (2 / (1 + math.sqrt(2)) * major * major).alias("ocm"),
            total(p, lambda q: F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])).alias("rda"), total(pairs(p, angle)).alias("sam"),
            (0.5 * total(pairs(p, lambda a, b: F.abs(a["x"] * b["y"] - b["x"] * a["y"])))).alias("ots"), total(F.zip_with(u, v, lambda a, b: F.abs(a * b))).alias("oam"),
            (math.pi * F.sqrt(variance(u)) * F.sqrt(variance(v))).alias("bdi"), (math.pi * major * minor).alias("ecm"),
        )

    def body(p):
        tri = F.transform(indices(F.size(p) - 2), lambda i: triangle(F.get(p, i), F.get(p, i + 1), F.get(p, i + 2)))
        moments = [mean(p, lambda q: q["x"] * q["x"]), mean(p, lambda q: q["y"] * q["y"]), mean(p, lambda q: q["x"] * q["y"])]
        return let(tri, lambda t: let(moments[0], lambda a: let(moments[1], lambda b: let(moments[2], lambda c: of(p, t, a, b, c)))))

    return F.when((F.size(x) >= 3 * tau + 4) & (F.sqrt(variance(x)) >= 1e-12), let(xy, body))


def phase_space_3d(x: Column, tau: int = 1, bins: int = 8, horizon: int = 10) -> Column:
    """Struct sci, dem, tbi, tti of the three-dimensional embedding. sci is the exponential of an entropy in bits."""
    m = F.size(x) - 2 * tau
    q = F.transform(indices(m), lambda i: F.array(*[F.get(x, i + k * tau) for k in range(3)]))
    minus = lambda a, b: F.array(*[F.get(a, F.lit(k)) - F.get(b, F.lit(k)) for k in range(3)])
    norm = lambda a: F.sqrt(total(a, lambda v: v * v))
    at = lambda a, k: F.get(a, F.lit(k))
    cross = lambda a, b: F.array(*[at(a, (k + 1) % 3) * at(b, (k + 2) % 3) - at(a, (k + 2) % 3) * at(b, (k + 1) % 3) for k in range(3)])
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))

    def complexity(qs):
        def cell(lo, hi):
            part = lambda v, k: F.least(F.floor((at(v, k) - at(lo, k)) / F.greatest(at(hi, k) - at(lo, k), F.lit(EPS)) * bins), F.lit(bins - 1))
            return F.transform(qs, lambda v: part(v, 0) * bins * bins + part(v, 1) * bins + part(v, 2))

        axis = lambda k: F.transform(qs, lambda v: at(v, k))
        ends = lambda f: F.array(*[f(axis(k)) for k in range(3)])
        share = lambda cells: lambda c: (F.size(cells) - F.size(F.array_remove(cells, c))).cast("double") / F.size(cells)
        cells = let(ends(F.array_min), lambda lo: let(ends(F.array_max), lambda hi: cell(lo, hi)))
        return let(cells, lambda c: F.exp(total(F.transform(F.array_distinct(c), share(c)), lambda p: -p * F.log2(p))))

    def divergence(qs):
        ks = F.filter(F.array(*map(F.lit, range(1, horizon + 1))), lambda k: k <= F.size(qs) - 2)
        far = lambda k: mean(F.transform(indices(F.size(qs) - k), lambda i: norm(minus(F.get(qs, i + k), F.get(qs, i)))))
        return mean(F.transform(ks, lambda k: F.ln(far(k) + F.lit(EPS))))

    def bends(qs):
        # first, second and third differences, cut to the length of the third
        d1 = lambda i: minus(F.get(qs, i + 1), F.get(qs, i))
        d2 = lambda i: minus(d1(i + 1), d1(i))
        d3 = lambda i: minus(d2(i + 1), d2(i))
        step = lambda a, b, c: let(cross(a, b), lambda ab: F.struct(norm(a).alias("n1"), norm(ab).alias("ncr"), dot(a, cross(b, c)).alias("twist")))
        return F.transform(indices(F.size(qs) - 3), lambda i: let(d1(i), lambda a: let(d2(i), lambda b: let(d3(i), lambda c: step(a, b, c)))))

    def of(qs, steps):
        bent = F.filter(steps, lambda s: s["n1"] > 1e-9)
        twisted = F.filter(steps, lambda s: s["ncr"] > 1e-9)
        return F.struct(
            complexity(qs).alias("sci"), divergence(qs).alias("dem"), mean(bent, lambda s: s["ncr"] / F.pow(s["n1"], F.lit(3.0))).alias("tbi"),
            let(twisted, lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(mean(t, lambda s: s["twist"] / (s["ncr"] * s["ncr"])))).alias("tti"),
        )

    return F.when((F.size(x) >= 3 * tau + 4) & (F.sqrt(variance(x)) >= 1e-12), let(q, lambda qs: let(bends(qs), lambda s: of(qs, s))))
