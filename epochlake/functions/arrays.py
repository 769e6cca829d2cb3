"""Small building blocks for array columns of doubles, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def mean(a: Column, f=lambda v: v) -> Column:
    """Mean of f over the elements; null for an empty array."""
    return F.try_divide(total(a, f), F.size(a))


def variance(a: Column) -> Column:
    """Sample variance; 0 for one element, as a single epoch must not turn into null."""
    return let(mean(a), lambda m: F.when(F.size(a) < 2, F.lit(0.0)).otherwise(total(a, lambda v: (v - m) * (v - m)) / (F.size(a) - 1)))


def pairs(a: Column, f, lag: int = 1) -> Column:
    """f(a[i], a[i + lag]) for each i."""
    n = F.greatest(F.size(a) - lag, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + lag), n), f)


def diff(a: Column) -> Column:
    return pairs(a, lambda p, q: q - p)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))


def z_scored(a: Column) -> Column:
    """(x - mean) / (standard deviation + eps)."""
    return let(mean(a), lambda m: let(F.sqrt(variance(a)) + F.lit(EPS), lambda s: F.transform(a, lambda v: (v - m) / s)))


def slope(xs: Column, ys: Column) -> Column:
    """Least-squares slope of ys on xs; null where it isn't defined."""

    def of(mx, my):
        top = total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my)))
        return F.try_divide(top, total(xs, lambda x: (x - mx) * (x - mx)))

    return let(mean(xs), lambda mx: let(mean(ys), lambda my: of(mx, my)))
