"""Codes of vectors against a plain version; nulls, ties, repeats, large numbers, other lengths, empty tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Everything in Python integers; rows (vec_id, embedding, label) with an id each and one length."""
    kept = sorted((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    whole = lambda x: math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale
    x = [[whole(c) for c in v] for _, v, _ in kept]
    size = len(x[0]) // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for v in x[:entries]] for p in range(parts)]

    def codes():
        out = []
        for v in x:
            best = []
            for p in range(parts):
                best.append(min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), e) for e, c in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        found = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [part(v, p) for v, f in zip(x, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = codes()
    errors = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    end = 2**63 - 1
    return {i: ("".join(f"{e:02x}" for _, e in f), min(err, end), min(by[lab], end), sha) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)}


def result(spark, rows, **kw):
    df = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA), **kw)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return df.collect()


def as_dict(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


def test_against_a_plain_version_with_nulls_and_ties(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(0, 0.2, 16).tolist(), int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(40)] + [(300 + i, [0.0] * 16, None) for i in range(40)]
    rows += [(400, None, 1), (401, [0.1] * 15 + [None], 1), (402, [0.1] * 15 + [math.nan], 1), (403, [math.inf] * 16, None), (404, [-0.00001] * 16, 2)]
    assert as_dict(result(spark, rows)) == plain(rows)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(i % 5) * 10.0 ** (30 if i % 2 else 300)] * 4 + [i / 7.0] * 4, 0) for i in range(40)]
    assert as_dict(result(spark, rows, parts=4, entries=4, rounds=2)) == plain(rows, 4, 4, 2)


def test_fewer_rows_than_entries_lengths_ids_and_repeats(spark):
    rows = [(5, [1.0, 2.0, 3.0], 1), (5, [0.5, 2.0, 3.0], 1), (7, [9.0], 1), (None, [1.0, 2.0, 4.0], None)]
    out = result(spark, rows)
    mine = sorted((r for r in out if r[0] == 5), key=lambda r: r[2])
    assert len(out) == 4 and all(len(r[1]) == 16 for r in mine)
    other = next(r for r in out if r[0] == 7)
    assert (other[1], other[2], other[3]) == (None, None, None)
    assert next(r for r in out if r[0] is None)[1] is not None


def test_without_an_id_or_a_row(spark):
    assert result(spark, []) == []
    (row,) = result(spark, [(None, [1.0] * 8, 1)])
    assert tuple(row)[:4] == (None, None, None, None)


def test_clashing_columns(spark):
    rows = [(i, [i / 9.0] * 8, 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "codes", "error", "label_key", "n", "part", "code")})
    assert as_dict(vector_codes.vector_codes(df).collect()) == plain(rows)


@pytest.mark.parametrize("bits", [3, 5])
def test_filter_leaves_the_nearest_entry(bits):
    r = np.random.default_rng(1)
    entries, x = r.integers(-4000, 4000, (16, 8)), r.integers(-5000, 5000, (500, 8))
    file = vector_codes.Approximations(entries, bits)
    d = ((x[:, None, :] - entries) ** 2).sum(2)
    low, high = file.bounds(x)
    assert (low <= d).all() and (d <= high).all()
    index, least = file.nearest(x)
    assert (index == d.argmin(1)).all() and (least == d.min(1)).all()
    assert (low <= high.min(1)[:, None]).mean() < 0.9  # the filter leaves some out
