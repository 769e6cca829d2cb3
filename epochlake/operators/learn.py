"""Learners and evaluation protocols over long feature tables (subject, epoch, y, feature, value).

The nearest-centroid learner is sums: one pass over the features gives what every
fold needs, since the training part of a fold is the total less the fold. Trees and
forests are MLlib's, fitted fold by fold on the cluster.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlake.sources.stores import held

from . import ranks


def centroid_models(long: DataFrame, keys: list[str], fold: str = "fold", holdout: bool = True) -> DataFrame:
    """(keys, fold, feature, mean, sd, c1, c0): scaling and scaled class centres of the rows outside each fold.

    Without holdout a model is of all rows. A deviation under 1e-12 counts as 1; features without rows of both classes in training are left out.
    """
    one = lambda y, c: F.coalesce(F.sum(F.when(F.col("y") == y, c)), F.lit(0.0))
    v = F.col("value")
    parts = long.filter(v.isNotNull()).groupBy(*keys, fold, "feature").agg(
        one(1, F.lit(1.0)).alias("n1"), one(0, F.lit(1.0)).alias("n0"), one(1, v).alias("s1"), one(0, v).alias("s0"), F.sum(v * v).alias("q")
    )
    # every fold is a model, also for features that have no rows inside it
    models = parts.select(*keys, fold).distinct()
    total = Window.partitionBy(*keys, "feature")
    names = ["n1", "n0", "s1", "s0", "q"]
    sums = parts.select(*keys, "feature", *[F.sum(c).over(total).alias(c) for c in names]).distinct()
    own = parts.select(*keys, fold, "feature", *[F.col(c).alias(f"_{c}") for c in names])
    left = models.join(sums, keys).join(own, [*keys, fold, "feature"], "left") if keys else sums.crossJoin(F.broadcast(models)).join(own, [fold, "feature"], "left")  # a row for each fold
    t = {c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)) if holdout else F.col(c) for c in names}
    n, s = t["n1"] + t["n0"], t["s1"] + t["s0"]
    variance = (t["q"] - s * s / n) / (n - 1)
    fitted = left.filter((t["n1"] > 0.5) & (t["n0"] > 0.5)).select(*keys, fold, "feature", (s / n).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("_sd"), (t["s1"] / t["n1"]).alias("_m1"), (t["s0"] / t["n0"]).alias("_m0"))
    sd = F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd"))
    return fitted.select(*keys, fold, "feature", "mean", sd.alias("sd"), ((F.col("_m1") - F.col("mean")) / sd).alias("c1"), ((F.col("_m0") - F.col("mean")) / sd).alias("c0"))


def centroid_predictions(long: DataFrame, models: DataFrame, row: list[str], on: list[str]) -> DataFrame:
    """(row, yhat, score): rows against the models that share the `on` columns; score is the distance to class 0 over both."""
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    square = lambda c: F.sum((z - F.col(c)) * (z - F.col(c)))
    far = long.join(models, [*on, "feature"]).groupBy(*row).agg(F.sqrt(square("c1")).alias("d1"), F.sqrt(square("c0")).alias("d0"))
    return far.select(*row, (F.col("d1") < F.col("d0")).cast("int").alias("yhat"), F.coalesce(F.try_divide(F.col("d0"), F.col("d0") + F.col("d1")), F.lit(0.5)).alias("score"))


def wide(long: DataFrame, row: list[str], features: list[str]) -> DataFrame:
    """(row, features): one array a row, in the order of the names; missing values are null."""
    by = long.groupBy(*row).agg(*[F.first(F.when(F.col("feature") == f, F.col("value")), ignorenulls=True).alias(f"_{i}") for i, f in enumerate(features)])
    return by.select(*row, F.array(*[F.col(f"_{i}") for i in range(len(features))]).alias("features"))


def estimator(name: str, seed: int = 1, **params):
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier

    kinds = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "svm": LinearSVC}
    common = {"featuresCol": "vector", "labelCol": "y", "weightCol": "weight"}
    return kinds[name](**common, **({} if name == "svm" else {"seed": seed}), **params)


def flattened(rows: DataFrame, fold: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with a column for each feature, held: every fold's imputer, weights, model and predictions read them."""
    n = len(rows.select("features").first()["features"])
    names = [f"f{i}" for i in range(n)]
    return held(rows.select(*keep, "y", fold, *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(n)])), names


def fitted_on(flat: DataFrame, names: list[str], fold: str, k, keep: list[str], name: str, **params) -> DataFrame:
    """Predictions of fold k; a parameter may be a function of the training part."""
    from pyspark.ml.feature import Imputer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    train = flat.filter(F.col(fold) != k)
    params = {p: v(train) if callable(v) else v for p, v in params.items()}
    # medians are sorted for: only columns with something to fill have one
    missing = flat.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in names]).first()
    gaps = [c for c in names if missing[c]]
    filled = Imputer(strategy="median", inputCols=gaps, outputCols=gaps, relativeError=0.001).fit(train).transform if gaps else lambda df: df
    counts = train.groupBy("y").agg((1 / F.count("*")).alias("weight"))
    vector = array_to_vector(F.array(*names)).alias("vector")
    fitted = estimator(name, **params).fit(filled(train).join(F.broadcast(counts), "y").select("y", "weight", vector))
    done = fitted.transform(filled(flat.filter(F.col(fold) == k)).select(*keep, "y", fold, vector))
    score = vector_to_array("probability")[1] if "probability" in done.columns else vector_to_array("rawPrediction")[1]
    return done.select(*keep, "y", fold, F.col("prediction").cast("int").alias("yhat"), score.alias("score"))


def fold_predictions(rows: DataFrame, fold: str, k, keep: list[str], name: str, **params) -> DataFrame:
    """(keep, y, fold, yhat, score) of the rows of fold k, by learner `name` fitted on the others with equal weight for both classes."""
    return fitted_on(*flattened(rows, fold, keep), fold, k, keep, name, **params)


def cross_validated(rows: DataFrame, fold: str, keep: list[str], name: str, threads: int = 4, prepare=None, **params) -> DataFrame:
    """(keep, y, fold, yhat, score): MLlib learner `name`, fitted outside each fold with equal weight for both classes.

    rows: (keep, y, fold, features array<double>). Missing values are filled by training medians. The fits of the folds
    are independent jobs, `threads` of them at a time. `prepare`, given a training part, returns a function of rows (a feature map);
    a parameter may be a function of the training part.
    """
    if prepare:
        rows = held(rows)
        one = lambda k: fitted_on(*flattened(prepare(rows.filter(F.col(fold) != k))(rows), fold, keep), fold, k, keep, name, **params)
    else:
        flat, names = flattened(rows, fold, keep)
        one = lambda k: fitted_on(flat, names, fold, k, keep, name, **params)
    ks = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]  # a few folds
    with ThreadPool(threads) as pool:
        parts = pool.map(one, ks)
    return reduce(DataFrame.unionByName, parts)


def nystroem(training: DataFrame, key: list[str], landmarks: int = 64, seed: int = 1, standardised: bool = False):
    """A function that replaces the features of rows by Nystroem features of an RBF kernel, fitted on a training part.

    Landmarks are that many of the training rows in a seeded order; the kernel's scale is the median distance between
    them, and the features are the kernel with the landmarks times the inverse root of the landmarks' own, so that products of
    features are the kernel as far as the landmarks span it. Missing values count as 0. A table of landmarks times features, whatever the rows.
    Standardised, features are first brought to mean 0 and deviation 1 by the training part, where missing values are left out.
    """
    import pandas as pd

    from . import folds

    few = training.orderBy(folds.shuffled(seed, *key), *key).select("features").limit(landmarks).collect()
    marks = np.array([r[0] for r in few], float)
    shift, width = 0.0, 1.0
    if standardised:
        v = training.select(F.posexplode("features").alias("i", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
        by = {r["i"]: r for r in v.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd")).collect()}
        shift = np.array([by[i]["m"] if i in by else 0.0 for i in range(marks.shape[1])])
        width = np.array([by[i]["sd"] if i in by and (by[i]["sd"] or 0) > 1e-12 else 1.0 for i in range(marks.shape[1])])
    marks = np.nan_to_num((marks - shift) / width)
    far = ((marks[:, None] - marks) ** 2).sum(2)
    apart = far[np.triu_indices(len(marks), 1)]
    apart = apart[apart > 0]
    scale = float(np.median(apart)) if len(apart) else 1.0
    values, vectors = np.linalg.eigh(np.exp(-far / scale))
    kept = values > 1e-9 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])

    def run(s: pd.Series) -> pd.Series:
        x = np.nan_to_num((np.array(s.tolist(), float).reshape(len(s), -1) - shift) / width)
        d = np.maximum((x * x).sum(1)[:, None] + (marks * marks).sum(1) - 2 * x @ marks.T, 0)
        return pd.Series(list(np.exp(-d / scale) @ root), dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda rows: rows.withColumn("features", F.pandas_udf(run, "array<double>")("features"))


class Cells:
    """Voronoi cells of the training rows of each part: pivots, how far from its pivot a cell reaches, its rows, and groups of near cells."""

    def __init__(self, pivots: dict[tuple, np.ndarray]):
        self.pivots = pivots
        self.radius = {g: np.zeros(len(p)) for g, p in pivots.items()}
        self.rows = {g: np.zeros(len(p), np.int64) for g, p in pivots.items()}
        #: rows with a missing value: infinitely far from everything
        self.odd = {g: 0 for g in pivots}
        #: the cells of each group, and the groups of each cell, more than one if its rows are dealt; -1: the odd rows
        self.groups: dict[tuple, list[np.ndarray]] = {g: [] for g in pivots}
        self.of: dict[tuple, dict[int, list[int]]] = {g: {} for g in pivots}

    def grouped(self, most: int) -> None:
        """Deals the cells of each part to groups of at most `most` rows, near cells together; a larger cell has groups of its own."""
        for g, p in self.pivots.items():
            left, found = [np.arange(len(p))] if len(p) else [], self.groups[g]
            while left:
                cells = left.pop()
                n = int(self.rows[g][cells].sum())
                if n <= most or len(cells) == 1:
                    found += [cells] * max(1, -(-n // most))
                    continue
                cells = cells[np.argsort(p[cells, np.ptp(p[cells], axis=0).argmax()], kind="stable")]
                cut = int(np.clip(np.searchsorted(np.cumsum(self.rows[g][cells]), n / 2), 1, len(cells) - 1))
                left += [cells[:cut], cells[cut:]]
            found += [np.array([-1])] * -(-self.odd[g] // most)
            for i, cells in enumerate(found):
                for c in cells.tolist():
                    self.of[g].setdefault(c, []).append(i)

    def size(self, g: tuple, group: int) -> int:
        """About how many rows a group has."""
        cells = self.groups[g][group]
        n = self.odd[g] if cells[0] < 0 else int(self.rows[g][cells].sum())
        return -(-n // len(self.of[g][int(cells[0])]))

    def far(self, g: tuple, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        p = self.pivots[g]
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))

    def home(self, far: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(far), np.inf, far).argmin(1)

    def nearest(self, far: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Which cells are the nearest ones that hold k rows."""
        order = np.argsort(np.where(np.isnan(far), np.inf, far), axis=1, kind="stable")
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, np.cumsum(rows[order], axis=1) - rows[order] < k, 1)
        return out

    def within(self, g: tuple, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which cells may hold a row as near as kth (squared): by their reach, and by the planes midway between pivots, beyond which another cell's rows are."""
        far, p = self.far(g, x), self.pivots[g]
        home = self.home(far)
        own, at = np.unique(home, return_inverse=True)
        apart = self.far(g, p[own])[at]
        # distances by products have an error, which may only add cells
        scale = (1 + np.abs(p).max(initial=0) + self.radius[g].max(initial=0) + np.nan_to_num(np.abs(x)).max(1, initial=0))[:, None]
        with np.errstate(all="ignore"):
            plane = (far * far - np.take_along_axis(far, home[:, None], 1) ** 2 - 1e-9 * scale * scale) / (2 * apart)
        least = np.maximum(far - self.radius[g] - 1e-6 * scale, np.where(apart > 1e-4 * scale, plane, 0))
        return ~(np.maximum(least, 0) > np.sqrt(kth)[:, None])

    def visits(self, g: tuple, x: np.ndarray, kth: np.ndarray, k: int, first: bool) -> list[np.ndarray]:
        """Cells that each query looks into: the nearest ones that hold k rows, or all others that may hold a row as near as kth (squared)."""
        far = self.far(g, x)
        near = self.nearest(far, self.rows[g], k)
        return [np.flatnonzero(m) for m in (near if first else self.within(g, x, kth) & ~near)]

    def asked(self, g: tuple, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which groups may hold a row as near as kth (squared)."""
        cells = self.within(g, x, kth) if len(self.pivots[g]) else None
        return np.stack([np.isinf(kth) if c[0] < 0 else cells[:, c].any(1) for c in self.groups[g]], 1)


def _best(q: np.ndarray, at: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least distances of each query, ties by rank, in that order."""
    o = np.lexsort((rank[at], d, q))
    q = q[o]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[kept], at[o][kept], d[o][kept]


def looked(q: np.ndarray, kth: np.ndarray, visits: np.ndarray, x: np.ndarray, cuts: np.ndarray, rank: np.ndarray, k: int, room: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance): the k nearest rows of each query that aren't beyond its kth, in the cells that it visits.

    Cell c is rows cuts[c] to cuts[c + 1] of x; rank decides ties. About `room` distances are held at a time, however many are equal.
    """
    own, squares = (q * q).sum(1), (x * x).sum(1)
    found, size = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for c in np.flatnonzero(visits.any(0)):
        a, b = int(cuts[c]), int(cuts[c + 1])
        if a == b:
            continue
        asking = np.flatnonzero(visits[:, c])
        step = max(1, room // (b - a))
        for i in (asking[s : s + step] for s in range(0, len(asking), step)):
            # products give distances with a small error, so all rows that may be among the k best are measured again
            near = own[i][:, None] + squares[a:b] - 2 * (q[i] @ x[a:b].T)
            near[np.isnan(near)] = np.inf
            slack = np.nan_to_num(1e-9 * (own[i] + squares[a:b].max()), nan=np.inf, posinf=np.inf)
            hit = near <= (kth[i] + slack)[:, None]
            if b - a > k and hit.sum() > 2 * k * len(i):
                hit &= near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None]
            r, j = np.nonzero(hit)
            part = max(1, room // q.shape[1])
            d = np.concatenate([((x[a + j[s : s + part]] - q[i[r[s : s + part]]]) ** 2).sum(1) for s in range(0, len(r), part)] or [np.empty(0)])
            d[np.isnan(d)] = np.inf
            near_ones = d <= kth[i][r] * (1 + 1e-9)
            found.append(_best(i[r[near_ones]], a + j[near_ones], d[near_ones], rank, k))
            size += len(found[-1][0])
            if size > room:
                found = [_best(*map(np.concatenate, zip(*found, strict=True)), rank, k)]
                size = len(found[0][0]) if len(found[0][0]) < room / 2 else 0
    return _best(*map(np.concatenate, zip(*found, strict=True)), rank, k)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long arrays; missing values are NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(column)
    if column.null_count or len(pc.unique(n)) > 1:
        raise ValueError("features must be arrays of one length")
    return np.array(pc.list_flatten(column).to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def neighbours(train: DataFrame, test: DataFrame, row: list[str], k: int, order: list[str] | None = None, within: tuple[str, ...] | list[str] = (), block_rows: int = 65536, cell_rows: int = 512, most_cells: int = 1024, unit_pairs: float = 4e9) -> DataFrame:
    """(within, row, _n, _d, _y): the k nearest training rows of each test row, with place, squared distance and class; ties to the earlier row.

    train: (within, y, features), of any size, in the order of the columns `order`, or as the rows come. `row` names a test
    row; rows meet where the columns `within` are equal, of which there are few. Training rows belong to the nearest of the pivots, a seeded sample of
    at most most_cells in each part; near cells make a group of at most block_rows rows (32 MB), which a task holds while test rows stream by.
    A test row first goes to the group of its own cell, where its k-th distance is found, and with it the groups that may hold a nearer row by
    the triangle inequality: if that is only this group, it is done there, else all of them are asked, with that bound. A group is sent once, or
    once for each unit_pairs of its rows and the test rows that ask it; a test row is sent once to each group that it asks.
    """
    import pyarrow as pa

    known = train.withColumn("_o0", F.monotonically_increasing_id()) if order is None else train.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)})
    places = [f"_o{i}" for i in range(len(order or [0]))]
    within = list(within)
    # both sides may come from one table: this one's columns are new ones
    known = known.select(*[F.col(c).alias(c) for c in within], F.col("y").cast("double").alias("_y"), F.col("features").alias("features"), *[F.col(c).alias(c) for c in places])
    if order is None:
        known = held(known)
    whole = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    group = lambda r: tuple(r[c] for c in within)
    # a row for each part
    sizes = {group(r): r["n"] for r in known.groupBy(*within).agg(F.count("*").alias("n")).collect()}
    wanted = max([min(most_cells, -(-n // cell_rows)) for n in sizes.values()], default=1)
    first_ones = Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.xxhash64(*places), *places)
    picked: dict[tuple, list] = {g: [] for g in sizes}
    for r in known.filter(whole).withColumn("_r", F.row_number().over(first_ones)).filter(F.col("_r") <= wanted).orderBy("_r").collect():
        if len(picked[group(r)]) < min(most_cells, -(-sizes[group(r)] // cell_rows)):
            picked[group(r)].append(r["features"])
    space = Cells({g: np.array(p, float).reshape(len(p), -1) for g, p in picked.items()})
    width = max([p.shape[1] for p in space.pivots.values()], default=1)

    def parts(batch):
        """(part, positions of its rows) of a batch."""
        by: dict[tuple, list[int]] = {}
        for i, g in enumerate(zip(*[batch.column(c).to_pylist() for c in within], strict=True) if within else [()] * batch.num_rows):
            by.setdefault(g, []).append(i)
        return ((g, np.array(at)) for g, at in by.items())

    def placed(batches):
        for b in (whole_.slice(s, 1024) for whole_ in batches for s in range(0, whole_.num_rows, 1024)):
            cell, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            x = matrix(b.column("features"))
            for g, at in parts(b):
                fine = at[np.isfinite(x[at]).all(1)]
                if len(fine):
                    d = space.far(g, x[fine])
                    cell[fine], far[fine] = d.argmin(1), d.min(1)
            yield b.append_column("_cell", pa.array(cell, pa.int32())).append_column("_far", pa.array(far))

    known = held(known.mapInArrow(placed, T.StructType([*known.schema, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])))
    for r in known.groupBy(*within, "_cell").agg(F.count("*").alias("n"), F.max("_far").alias("far")).collect():
        g, c = group(r), r["_cell"]
        if c < 0:
            space.odd[g] = r["n"]
        else:
            space.rows[g][c], space.radius[g][c] = r["n"], r["far"]
    space.grouped(max(2 * k, min(block_rows, 4_000_000 // max(1, width))))
    asked = test.select(*[F.col(c).alias(c) for c in within], *[F.col(c).alias(c) for c in row], F.col("features").alias("features")).withColumn("_h", F.xxhash64(*row)).withColumns({"_kth": F.lit(float("inf")), "_home": F.lit(-1)})

    def goes(x, g, h, kth, home, everywhere):
        """(position, group) of rows of a part: all groups that may hold a near row, or the own one."""
        if everywhere:
            return np.nonzero(space.asked(g, x, kth))
        if len(space.pivots[g]) and (home < 0).any():
            cell = space.home(space.far(g, x))
            home = np.array([space.of[g][c][v % len(space.of[g][c])] for c, v in zip(cell.tolist(), h.tolist(), strict=True)])
        return np.arange(len(x)), np.where(home < 0, h % len(space.groups[g]), home)

    def sent(units, everywhere):
        """Test rows with the unit of work that they go to; without units, (within, _group) alone."""

        def run(batches):
            for b in (whole_.slice(s, 1024) for whole_ in batches for s in range(0, whole_.num_rows, 1024)):
                x, h, kth, home = matrix(b.column("features")), *(b.column(c).to_numpy() for c in ("_h", "_kth", "_home"))
                for g, at in parts(b):
                    if g not in space.pivots:
                        continue
                    i, to = goes(x[at], g, h[at], kth[at], home[at], everywhere)
                    for s in range(0, len(i), 8192):
                        mine, where = at[i[s : s + 8192]], to[s : s + 8192]
                        if units is None:
                            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(mine)) for c in within], pa.array(where, pa.int32())], [*within, "_group"])
                        else:
                            unit = [units[g, n][0] + v % units[g, n][1] for n, v in zip(where.tolist(), h[mine].tolist(), strict=True)]
                            yield b.take(pa.array(mine)).append_column("_unit", pa.array(unit, pa.int32()))

        return run

    def dealt(queries, everywhere):
        """{(part, group): (first unit, how many)} of the groups that are asked."""
        schema = T.StructType([*queries.select(*within).schema, T.StructField("_group", T.IntegerType())])
        out, n = {}, 0
        for r in queries.mapInArrow(sent(None, everywhere), schema).groupBy(*within, "_group").agg(F.count("*").alias("n")).collect():
            g, i = group(r), r["_group"]
            many = max(1, int(-(-r["n"] * space.size(g, i) // unit_pairs)))
            out[g, i] = (n, many)
            n += many
        return out, n

    def met(queries, units, n, everywhere, found, schema):
        """What `found` makes of each unit of work: the rows of a group, then the test rows that ask it."""
        sent_schema = T.StructType([*queries.schema, T.StructField("_unit", T.IntegerType())])
        theirs = queries.mapInArrow(sent(units, everywhere), sent_schema).withColumn("_tag", F.lit(1))
        spans = [(*g, c, [list(range(units[g, i][0], sum(units[g, i]))) if (g, i) in units else [] for i in groups]) for g, of in space.of.items() for c, groups in of.items()]
        spans_schema = T.StructType([*[known.schema[c] for c in within], T.StructField("_cell", T.IntegerType()), T.StructField("_units", T.ArrayType(T.ArrayType(T.IntegerType())))])
        own = known.drop("_far").join(F.broadcast(known.sparkSession.createDataFrame(spans, spans_schema)), [*within, "_cell"])  # a row for each cell
        own = own.withColumn("_unit", F.explode(F.get("_units", F.pmod(F.xxhash64(*places), F.size("_units")).cast("int")))).drop("_units").withColumn("_tag", F.lit(0))
        both = own.unionByName(theirs, allowMissingColumns=True)
        home_of = {first + j: key for key, (first, many) in units.items() for j in range(many)}

        def run(batches):
            unit, rows, ready = None, [], None
            for b in batches:
                tags = b.column("_unit").to_numpy() * 2.0 + b.column("_tag").to_numpy()
                ends = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), b.num_rows]
                for s, e in zip(ends, ends[1:], strict=False):
                    if s == e:
                        continue
                    part = b.slice(s, e - s)
                    u, tag = part.column("_unit")[0].as_py(), part.column("_tag")[0].as_py()
                    if u != unit:
                        unit, rows, ready = u, [], None
                    if tag == 0:
                        rows.append(part.select(["_y", *places, "_cell", "features"]))
                    elif rows or ready:
                        g, i = home_of[u]
                        if ready is None:
                            ready, rows = held_rows(rows, space.groups[g][i]), []
                        for q in range(0, part.num_rows, 1024):
                            yield from found(part.slice(q, 1024), g, i, *ready)

        done = both.repartition(max(1, n), "_unit").sortWithinPartitions("_unit", "_tag")
        return done.mapInArrow(run, schema)

    def held_rows(rows, cells):
        """(classes and places, features, where each cell begins, ranks) of the rows of a group, cell by cell."""
        t = pa.Table.from_batches(rows)
        # places from the first to the last, as the window below has them
        o = np.asarray(t.select(places).append_column("_i", pa.array(np.arange(len(t)))).sort_by([(c, "ascending") for c in places]).column("_i"))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o))
        where = {c: n for n, c in enumerate(cells.tolist())}
        at = np.array([where[c] for c in t.column("_cell").to_pylist()])
        by = np.argsort(at, kind="stable")
        return t.select(["_y", *places]).take(pa.array(by)), matrix(t.column("features"))[by], np.searchsorted(at[by], np.arange(len(cells) + 1)), rank[by]

    def bounded(b, g, i, _, x, cuts, rank):
        """Test rows with their k-th distance in the own group, and whether another group may hold a nearer row."""
        q, cells = matrix(b.column("features")), space.groups[g][i]
        kth = np.full(len(q), np.inf)
        if cells[0] >= 0:
            for near in (space.nearest(space.far(g, q)[:, cells], np.diff(cuts), k), None):
                near = space.within(g, q, kth)[:, cells] if near is None else near
                at, _, d = looked(q, kth, near, x, cuts, rank, k)
                last = np.searchsorted(at, np.arange(len(q)), "right")
                full = last - np.searchsorted(at, np.arange(len(q)), "left") == k
                kth[full] = d[last[full] - 1]
        elsewhere = space.asked(g, q, kth)
        elsewhere[:, i] = False
        b = b.select([*within, *row, "features", "_h"])
        yield b.append_column("_kth", pa.array(kth)).append_column("_home", pa.array([i] * len(q), pa.int32())).append_column("_many", pa.array(elsewhere.any(1)))

    def answered(b, g, i, known_, x, cuts, rank):
        q, kth, cells = matrix(b.column("features")), b.column("_kth").to_numpy(), space.groups[g][i]
        visits = np.ones((len(q), 1), bool) if cells[0] < 0 else space.within(g, q, kth)[:, cells]
        at, j, d = looked(q, kth, visits, x, cuts, rank, k)
        n = np.arange(len(at)) - np.searchsorted(at, at, "left") + 1
        for s in range(0, len(at), 16384):
            out = b.select([*within, *row]).take(pa.array(at[s : s + 16384]))
            also = known_.take(pa.array(j[s : s + 16384])).combine_chunks()
            for c in also.column_names:
                out = out.append_column(c, also.column(c).combine_chunks() if also.column(c).num_chunks != 1 else also.column(c).chunk(0))
            yield out.append_column("_d", pa.array(d[s : s + 16384])).append_column("_n", pa.array(n[s : s + 16384], pa.int32()))

    units, n = dealt(asked, False)
    bound_schema = T.StructType([*asked.schema, T.StructField("_many", T.BooleanType())])
    asked = held(met(asked, units, n, False, bounded, bound_schema))
    schema = T.StructType([*asked.select(*within, *row).schema, *known.select("_y", *places).schema, T.StructField("_d", T.DoubleType()), T.StructField("_n", T.IntegerType())])
    done = met(asked.filter("NOT _many").drop("_many"), units, n, False, answered, schema)
    others = asked.filter("_many").drop("_many")
    ordered = Window.partitionBy(*within, *row).orderBy("_d", *[F.asc_nulls_last(c) for c in places])
    rest = met(others, *dealt(others, True), True, answered, schema).withColumn("_n", F.row_number().over(ordered)).filter(F.col("_n") <= k)
    return done.unionByName(rest).select(*within, *row, "_n", "_d", "_y")


def uniform_prior(near: DataFrame, train: DataFrame, within: list[str]) -> DataFrame:
    """near with _p, by which a neighbour's vote counts so that both classes have the same weight in training: one over its class's rows."""
    # a row for each class and part
    counts = train.groupBy(*within, F.col("y").cast("double").alias("_y")).agg((1 / F.count("*")).alias("_p"))
    return near.join(F.broadcast(counts), [*within, "_y"])


def voted(near: DataFrame, keys: list[str], ks: list[int], weighted: bool) -> DataFrame:
    """(keys, k, yhat, score): for each k, the share of class 1 among the first k neighbours, by inverse distance if weighted, and by the weights _p if there are any."""
    weight = 1 / F.greatest(F.sqrt("_d"), F.lit(1e-12)) if weighted else F.lit(1.0)
    if "_p" in near.columns:
        weight = weight * F.col("_p")
    share = lambda k: F.sum(F.when(F.col("_n") <= k, weight * F.col("_y"))) / F.sum(F.when(F.col("_n") <= k, weight))
    scores = near.groupBy(*keys).agg(F.array(*[F.struct(F.lit(k).alias("k"), share(k).alias("score")) for k in ks]).alias("_v"))
    return scores.select(*keys, F.explode("_v").alias("_v")).select(*keys, "_v.k", (F.col("_v.score") > 0.5).cast("int").alias("yhat"), "_v.score")


def nearest(train: DataFrame, test: DataFrame, row: list[str], k: int, weighted: bool = False, order: list[str] | None = None, block_rows: int = 65536) -> DataFrame:
    """(row, yhat, score): share of class 1 among the k nearest training rows of neighbours()."""
    return voted(neighbours(train, test, row, k, order, (), block_rows), row, [k], weighted).drop("k")


def permuted_labels(subjects: DataFrame, n: int, seed: int) -> DataFrame:
    """(perm, subject, y): labels dealt anew among the subjects, n times, by orders of hashes."""
    many = subjects.crossJoin(F.broadcast(subjects.sparkSession.range(1, n + 1).toDF("perm")))
    order = lambda tag: F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), "perm", "subject").cast("binary"))
    at = lambda tag: ranks.places(many.withColumn("_h", order(tag)), ["perm"], "_h", ["subject"])
    return at("a").select("perm", "subject", "place").join(at("b").select("perm", "y", "place"), ["perm", "place"]).select("perm", "subject", "y")
