"""Neighbours by pivots and triangle bounds: the same as all pairs, with fewer rows looked at."""

import numpy as np
import pytest

from epochlake.operators import learn


def brute(train, test, k):
    out = {}
    for g, q, x in test:
        rows = []
        for h, i, y, v in train:
            if h == g:
                d = sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) if all(np.isfinite([*v, *x])) else np.inf
                rows.append((d, i, y))
        out[g, q] = [(i, y) for _, i, y in sorted(rows)[:k]]
    return out


def clusters(seed, groups=2, n=500, m=60):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 50, (groups, 12, 3))
    point = lambda g: (centre[g, r.integers(12)] + r.normal(0, 0.5, 3)).round(2).tolist()
    train = [(g, i, int(r.integers(2)), point(g)) for g in range(groups) for i in range(n)]
    train += [(0, 10_000 + i, 1, [1.0, 2.0, 3.0]) for i in range(150)]  # many equal rows
    test = [(g, q, point(g)) for g in range(groups) for q in range(m)] + [(0, 900, [1.0, 2.0, 3.0]), (1, 901, [9e3, 0.0, 0.0])]
    return train, test


@pytest.mark.parametrize(("k", "cell", "block"), [(5, 40, 64), (30, 16, 1000), (700, 64, 4096)])
def test_same_as_all_pairs(spark, k, cell, block):
    train, test = clusters(3)
    train += [(1, 20_000, 0, [float("nan"), 1.0, 1.0]), (2, 1, 1, [0.0, 0.0, 0.0])]
    test += [(1, 950, [float("nan"), 0.0, 0.0]), (2, 1, [5.0, 5.0, 5.0]), (7, 1, [0.0, 0.0, 0.0])]
    a = spark.createDataFrame(train, "part int, i int, y int, features array<double>").repartition(3)
    b = spark.createDataFrame(test, "part int, q int, features array<double>")
    got: dict = {}
    for r in learn.neighbours(a.withColumnRenamed("i", "at"), b, ["q"], k, ["at"], ["part"], block, cell).collect():
        got.setdefault((r["part"], r["q"]), []).append((r["_n"], r["_d"], r["_y"]))
    want = brute(train, test, k)
    label = {(g, i): y for g, i, y, _ in train}
    for key, near in want.items():
        mine = sorted(got.get(key, []))
        assert [y for *_, y in mine] == [label[key[0], i] for i, _ in near]
        assert [n for n, *_ in mine] == list(range(1, len(near) + 1))


def test_few_rows_are_looked_at_on_clustered_data():
    train, test = clusters(4, groups=1, n=4000, m=200)
    x, q = np.array([v for *_, v in train]), np.array([v for *_, v in test[:200]])
    r = np.random.default_rng(1)
    space = learn.Cells({(): x[r.choice(len(x), 64, replace=False)]})
    far = space.far((), x)
    cell = far.argmin(1)
    for c in range(64):
        space.rows[()][c] = (cell == c).sum()
        space.radius[()][c] = far[cell == c, c].max(initial=0)
    first = space.visits((), q, np.full(len(q), np.inf), 5, True)
    exact = ((q[:, None] - x) ** 2).sum(2)
    kth = [np.sort(exact[i, np.isin(cell, c)])[4] for i, c in enumerate(first)]
    second = space.visits((), q, np.array(kth), 5, False)
    looked = sum(space.rows[()][np.concatenate([a, b])].sum() for a, b in zip(first, second, strict=True))
    assert looked < 0.2 * len(x) * len(q)
    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        assert not set(a) & set(b)
        assert set(np.argsort(exact[i], kind="stable")[:5]) <= set(np.flatnonzero(np.isin(cell, np.concatenate([a, b]))))


@pytest.mark.parametrize(("dims", "n", "m"), [(3, 20_000, 20_000), (64, 8000, 2000)])
def test_rows_are_sent_a_few_times_only(spark, dims, n, m):
    r = np.random.default_rng(6)
    rows = lambda k: spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(r.normal(size=(k, dims)))], "id int, y int, features array<double>")
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(i) for i in range(s.size())])(spark._jvm.org.apache.spark.SparkContext.getOrCreate().statusStore().executorList(False)))
    train, test = rows(n), rows(m)
    before = shuffled()
    assert learn.neighbours(train, test, ["id"], 5, ["id"]).count() == 5 * m
    assert shuffled() - before < 5 * (n + m) * (8 * dims + 40)
