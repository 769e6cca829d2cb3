"""Every registered query with SQL gives the rows that DuckDB gives. Needs the synthetic tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from epochlake.functions import signal
from epochlake.plans import registry

from test_signal import brute_phrases

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float):
        # queries and statements round to the same digits
        return round(v, 12) + 0.0
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def epochs_of(duck):
    return {i: np.array(x, float) for i, x in duck.execute("SELECT vec_id, embedding::DOUBLE[] FROM embeddings").fetchall()}


def plain_wavelet(x):
    """Detail and approximation coefficients by the definition: correlation with the filter, every second value."""
    low = signal.daubechies(4)
    high = [low[7 - i] * (-1) ** i for i in range(8)]
    bands = []
    for _ in range(4):
        y = list(x[:7])[::-1] + list(x) + list(x[-7:])[::-1] if len(x) >= 7 else list(np.pad(x, 7, mode="symmetric"))
        conv = lambda f: [sum(y[i + 7 - j] * f[j] for j in range(8)) for i in range(len(y) - 7)]  # noqa: B023, E731
        bands.append(np.array(conv(high)[1::2]))
        x = np.array(conv(low)[1::2])
    return [*bands, x]


def test_wavelet_family_plainly(spark, duck):
    x = epochs_of(duck)
    for r in registry.QUERIES["wavelet_family"](spark, DATA).filter("vec_id < 40").collect():
        bands = plain_wavelet(x[r["vec_id"]])
        e = np.array([(b * b).sum() for b in bands])
        want = [*np.log(e + 2.220446049250313e-16), *(e / e.sum()), *[b.std(ddof=1) for b in bands], -(e / e.sum() * np.log(e / e.sum())).sum()]
        assert list(r)[1:] == pytest.approx(want, abs=2e-6)


def test_lempel_ziv_family_plainly(spark, duck):
    x = epochs_of(duck)
    for r in registry.QUERIES["lempel_ziv_family"](spark, DATA).collect():
        v = x[r["vec_id"]]
        assert r["complexity"] == pytest.approx(brute_phrases(list(v > np.median(v))) * math.log2(64) / 64, abs=1e-6)


def test_log_covariances_plainly(spark, duck):
    x = epochs_of(duck)
    got = {}
    for kind in ("full", "diag", "offdiag", "corr"):
        for r in registry.QUERIES[f"log_covariance_{kind}"](spark, DATA).filter("vec_id < 60").collect():
            got.setdefault(kind, {}).setdefault(r["vec_id"], {})[r["position"]] = r["value"]
    for i in range(60):
        c = np.cov(x[i].reshape(4, 16)[[1, 0, 3, 2]])  # channels by name: Cz, Fz, Oz, Pz
        c = c + 1e-3 * np.trace(c) / 4 * np.eye(4)
        d = np.sqrt(np.diag(c))
        log = lambda m: (lambda w, v: v @ np.diag(np.log(w)) @ v.T)(*np.linalg.eigh(m))
        upper = [(r, k) for k in range(4) for r in range(k + 1)]
        cells = lambda m, keep: [m[r, k] * (1 if r == k else math.sqrt(2)) for r, k in upper if keep(r, k)]
        full, corr = log(c), log(c / np.outer(d, d) + 1e-3 * np.eye(4))
        for kind, want in (("full", cells(full, lambda r, k: True)), ("diag", cells(full, lambda r, k: r == k)), ("offdiag", cells(full, lambda r, k: r != k)), ("corr", cells(corr, lambda r, k: r != k))):
            assert [got[kind][i][p] for p in range(len(want))] == pytest.approx(want, abs=2e-6)


def test_variational_family_plainly(spark, duck):
    x = epochs_of(duck)
    for r in registry.QUERIES["variational_family"](spark, DATA).filter("vec_id < 5").collect():
        z = (x[r["vec_id"]] - x[r["vec_id"]].mean()) / x[r["vec_id"]].std(ddof=1)
        y = np.concatenate([z[:32][::-1], z, z[32:][::-1]])
        s, f = np.fft.rfft(y), np.fft.rfftfreq(128)
        u, w = [np.zeros(65, complex) for _ in range(4)], [0.0625, 0.1875, 0.3125, 0.4375]
        for _ in range(200):
            before = [m.copy() for m in u]
            for k in range(4):
                u[k] = (s - sum(u[j] for j in range(4) if j != k)) / (1 + 4000 * (f - w[k]) ** 2)
                w[k] = (f * abs(u[k]) ** 2).sum() / (abs(u[k]) ** 2).sum()
            if sum((abs(a - b) ** 2).sum() for a, b in zip(u, before, strict=True)) < 1e-6 * sum((abs(b) ** 2).sum() for b in before):
                break
        modes = [np.fft.irfft(u[k], 128)[32:96] for k in np.argsort(w)]
        e = np.array([(m * m).sum() for m in modes])
        for k, m in enumerate(modes):
            assert r[f"m{k + 1}_log_energy"] == pytest.approx(math.log(e[k]), abs=1e-4) and r[f"m{k + 1}_rel_energy"] == pytest.approx(e[k] / e.sum(), abs=1e-4)
            assert r[f"m{k + 1}_mobility"] == pytest.approx(math.sqrt(np.diff(m).var(ddof=1) / m.var(ddof=1)), abs=1e-4)


def test_mode_audit_counts_missing_modes(spark):
    from epochlake.functions import decompose
    from epochlake.plans.feature_queries import store

    rows = decompose.modes(store(spark, DATA), ["vec_id"]).collect()
    for r in registry.QUERIES["mode_audit"](spark, DATA).collect():
        own = [x["x"] is None for x in rows if x["imf"] == r["imf"] and x["mode"] == r["mode"]]
        assert r["n"] == len(own) and r["missing"] == pytest.approx(sum(own) / len(own), abs=1e-6)


def test_filter_and_resample_energy(spark, duck):
    x = epochs_of(duck)
    for r in registry.QUERIES["filter_and_resample"](spark, DATA).filter("vec_id < 20").collect():
        y = signal.resampled(signal.cleaned(x[r["vec_id"]][None], 128.0), 128.0, 64.0)[0]
        assert r["n"] == 32 and r["energy"] == pytest.approx((y * y).sum(), abs=1e-6)


@pytest.mark.parametrize("name", ["tree_grouped_cv", "kernel_svm_grouped_cv"])
def test_learners_score_every_row_once(spark, duck, name):
    n = duck.execute("SELECT sum(c), count(*) FROM (SELECT user_id, count(*) // 8 AS c FROM events GROUP BY user_id HAVING count(*) // 8 >= 8)").fetchone()
    got = {r["level"]: r for r in registry.QUERIES[name](spark, DATA).collect()}
    assert (got["epoch"]["n"], got["subject"]["n"]) == n and all(0 <= r["bal"] <= 100 and 0 <= r["auc"] <= 1 for r in got.values())
