"""Exact top-k inner products over KD-trees, one for each shard of the vectors.

Space is cut into at most 1024 cells by median splits of a bounded sample, and a cell
with more rows than a shard holds is dealt to shards by a hash, so a vector that a third of
all rows share doesn't fill one shard. Each shard is a KD-tree: median splits on the
widest dimension down to small leaves, each leaf with its tight bounding box. A
block of queries visits a shard's leaves best first: the largest inner product
that a box allows is a bound, leaves are taken in falling order of it, and a query
is done with a shard when its next bound is below its k-th score so far.

A query takes the shards in falling order of the bound of their cell's box, in rounds: one
shard, then three, twelve and so on, four times as many in all after each. The k-th score of
the rounds before goes with it, and a shard whose box can't reach it isn't sent the query. So a
round gives about 3 * k candidates a query, and there are log4(shards) rounds. Leaves
are scored by matrix products in float64, which are exact while the sums stay
below 2**53; beyond that, Python integers are used.

Trees travel as one row for each shard and queries in blocks; both have a bounded
size, and no task holds more than one tree and one block at a time.

Nulls and edge cases: vectors that are null, or hold null or non-finite
components, and rows with a null id take no part; vectors of different lengths
aren't compared; rows that repeat an id are candidates each, none of them for a
query of that id, and a query id that repeats is asked once, with its smallest
vector; with fewer candidates than k all are returned; ties go to the smaller id;
a score outside the range of a long counts as the end of that range; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

EXACT = 2.0**53
LONG = 2**63 - 1
#: Cells of space, and sampled vectors for each of them.
CELLS, SAMPLED = 1024, 32
#: An array of doubles as Python integers.
whole = np.frompyfunc(int, 1, 1)


class Tree:
    """Leaves of a KD-tree with their bounding boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int = 128):
        self.ids, self.x, self.leaves = ids, x, []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            low, high = x[rows].min(0, initial=np.inf), x[rows].max(0, initial=-np.inf)
            width = high - low
            if len(rows) <= leaf_rows or not len(width) or width.max() == 0:
                self.leaves.append((rows, low, high))
                continue
            order = rows[np.argsort(x[rows, int(width.argmax())], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([low for _, low, _ in self.leaves])
        self.high = np.array([high for _, _, high in self.leaves])
        self.largest = float(np.abs(x).max()) if x.size else 0.0

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        """(query row, vec_id, score) of each query's best k with a score of kth or more; kth may be -inf."""
        exact = self.largest * float(np.abs(q).max() if q.size else 0) * max(1, q.shape[1]) < EXACT
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        # rounding may only raise a bound
        bound = np.where(np.isfinite(bound), bound + np.abs(bound) * 1e-9, np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        best: list[list[tuple]] = [[] for _ in q_ids]
        floor = kth.astype(float).copy()
        alive = np.arange(len(q_ids))
        for step in range(order.shape[1]):
            alive = alive[bound[alive, order[alive, step]] >= floor[alive]]
            if not len(alive):
                break
            # queries whose next leaf is the same are scored together
            for leaf in np.unique(order[alive, step]):
                at = alive[order[alive, step] == leaf]
                rows = self.leaves[leaf][0]
                if exact:
                    scores = q[at] @ self.x[rows].T
                else:
                    scores = np.clip(whole(q[at]).dot(whole(self.x[rows].T)), -LONG, LONG)
                for a, s in zip(at, scores, strict=True):
                    good = np.flatnonzero((s >= floor[a]) & (self.ids[rows] != q_ids[a]))
                    if not len(good):
                        continue
                    merged = best[a] + [(-int(v), int(i)) for v, i in zip(s[good], self.ids[rows[good]], strict=True)]
                    merged.sort()
                    best[a] = merged[:k]
                    if len(best[a]) == k:
                        # a float that isn't above the whole number
                        floor[a] = max(floor[a], np.nextafter(float(-best[a][-1][0]), -np.inf))
        return [(a, i, -v) for a, found in enumerate(best) for v, i in found]


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles, of the rows that take part."""
    most = F.lit(8e307)
    scaled = lambda x: F.greatest(-most, F.least(most, F.lit(float(scale)) * x.cast("double")))
    # doubles from 2**52 on are whole, and floor() would end at the range of a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(fine).select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


class Cells:
    """Cells of space for each vector length: nested median splits (dimension, value, below, from it on); -1 where nothing was sampled."""

    def __init__(self, samples: dict[int, np.ndarray], most: int):
        self.n = 0
        self.of = {dim: self.split(x, most) for dim, x in sorted(samples.items())}

    def split(self, x: np.ndarray, most: int):
        width = x.max(0) - x.min(0) if x.size else np.zeros(0)
        if most > 1 and len(x) > 1 and width.size and width.max() > 0:
            d = int(width.argmax())
            value = float(np.median(x[:, d]))
            if x[:, d].min() == value:
                # many rows share the least value, which is the median: they are one side
                value = float(x[x[:, d] > value, d].min())
            below = x[:, d] < value
            return d, value, self.split(x[below], most // 2), self.split(x[~below], most // 2)
        self.n += 1
        return self.n - 1

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1)
        todo = [(self.of.get(x.shape[1], -1), np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                below = x[rows, node[0]] < node[1]
                todo += [(node[2], rows[below]), (node[3], rows[~below])]
        return out


def dealt(points: DataFrame, total: int, shard_rows: int) -> DataFrame:
    """points with their cell and shard; a cell's shards have consecutive numbers."""
    most = max(1, min(CELLS, total // shard_rows))
    share = min(1.0, most * SAMPLED / max(1, total))
    sample: dict[int, list] = {}
    for r in points.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(2**20)) < int(share * 2**20)).limit(2 * most * SAMPLED).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    space = Cells({dim: np.array(x) for dim, x in sample.items()}, most)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.full(len(dims), -1)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cell[at] = space.find(matrix(b.column("v").take(pa.array(at))))
            yield b.append_column("cell", pa.array(cell, pa.int32()))

    placed = cut(points.mapInArrow(run, f"{points.schema.simpleString()[7:-1]}, cell: int"))
    # at most a row for each cell
    rows, first = [], 0
    for r in placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("splits")).orderBy("cell").collect():
        rows.append((r["cell"], r["splits"], first))
        first += r["splits"]
    sizes = points.sparkSession.createDataFrame(rows, "cell int, splits long, first long")
    return placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("splits"))).drop("first", "splits")


def trees(sharded: DataFrame) -> DataFrame:
    """(shard, dim, tree, cell, low, high): a pickled tree for each shard and vector length, and its box."""

    def build(key, table):
        x = matrix(table.column("v").combine_chunks())
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        box = [pa.array([y.tolist()], pa.list_(pa.float64())) for y in (x.min(0), x.max(0))]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(Tree(ids[order], x[order]))], pa.binary()),
                         "cell": table.column("cell").combine_chunks()[:1], "low": box[0], "high": box[1]})

    return sharded.groupBy("shard", "dim").applyInArrow(build, "shard long, dim int, tree binary, cell int, low array<double>, high array<double>")


def boxes(forest: DataFrame) -> dict[int, list[tuple]]:
    """For each vector length (low, high, shards) of its cells; what comes to the driver is a row for each cell and dimension."""
    sides = forest.select("dim", "cell", "shard", F.posexplode_outer(F.arrays_zip("low", "high")).alias("i", "x"))
    by = sides.groupBy("dim", "cell", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    cells = by.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("x")).select("dim", "cell", "x.low", "x.high")
    shards = forest.groupBy("dim", "cell").agg(F.min("shard").alias("first"), F.max("shard").alias("last"))
    out: dict[int, list[tuple]] = {}
    for r in cells.join(shards, ["dim", "cell"]).orderBy("dim", "cell").collect():
        ends = [np.array([v for v in r[c] if v is not None], float) for c in ("low", "high")]
        out.setdefault(r["dim"], []).append((*ends, range(r["first"], r["last"] + 1)))
    return out


def due(asked: DataFrame, space: dict[int, list[tuple]], start: int, stop: int) -> DataFrame:
    """asked (query_id, v, dim, block, kth) once for each shard that comes at places start .. stop - 1 of its order and may hold a score of kth."""
    ready = {dim: (np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), [c[2] for c in cells]) for dim, cells in space.items()}

    def run(batches):
        for b in batches:
            rows, shards = [], []
            dims, kth = b.column("dim").to_numpy(), b.column("kth").to_numpy()
            for dim in np.unique(dims):
                if dim not in ready:
                    continue
                low, high, ranges = ready[dim]
                at = np.flatnonzero(dims == dim)
                q = matrix(b.column("v").take(pa.array(at)))
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                bound = np.where(np.isfinite(bound), bound + np.abs(bound) * 1e-9, np.inf)
                for i, row in enumerate(at):
                    place = 0
                    for c in np.argsort(-bound[i], kind="stable"):
                        if place >= stop or bound[i, c] < kth[row]:
                            break
                        taken = ranges[c][max(0, start - place) : max(0, stop - place)]
                        rows += [row] * len(taken)
                        shards += taken
                        place += len(ranges[c])
            order = np.argsort(rows, kind="stable")
            yield b.take(pa.array(np.array(rows, np.int64)[order])).append_column("shard", pa.array(np.array(shards, np.int64)[order]))

    return asked.mapInArrow(run, f"{asked.schema.simpleString()[7:-1]}, shard: bigint")


def searched(blocks: DataFrame, forest: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of blocks (shard, dim, ids, vs, kths) of queries against the tree of their shard."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                tree = pickle.loads(b.column(0)[i].as_py())
                ids = np.array(b.column(1)[i].as_py(), np.int64)
                q = matrix(b.column(2)[i].values)
                kth = np.array(b.column(3)[i].as_py(), float)
                found = tree.search(ids, q, kth, k)
                rows, vecs, scores = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(rows)], pa.int64()), pa.array(vecs, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    pairs = blocks.join(forest.select("shard", "dim", "tree"), ["shard", "dim"]).select("tree", "ids", "vs", "kths")
    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def blocks_of(queries: DataFrame, rows: int) -> DataFrame:
    """Queries (shard, block, dim, query_id, v, kth) packed to one row for each shard and block."""
    packed = F.array_sort(F.collect_list(F.struct("query_id", "v", "kth")))
    return queries.groupBy("shard", "dim", "block").agg(packed.alias("p")).select("shard", "dim", F.col("p.query_id").alias("ids"), F.col("p.v").alias("vs"), F.col("p.kth").alias("kths"))


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64, shard_rows: int = 2048, block_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by query_every, its k best rows."""
    points = cut(quantized(vectors, scale))
    total = points.count()
    forest = cut(trees(dealt(points, total, shard_rows)))
    space, shards = boxes(forest), forest.agg(F.max("shard")).first()[0]
    asked = points.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("v", F.struct("dim", "v")).alias("v"))
    blocks = max(1, -(-total // (query_every * block_rows)))
    asked = cut(asked.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks))))
    found, start, stop = None, 0, 1
    while found is None or start <= (shards or 0):
        if found is None:
            bounded = asked.withColumn("kth", F.lit(float("-inf")))
        else:
            kths = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
            # as a double, never above the k-th score
            least = F.col("least").cast("double")
            bounded = asked.join(kths, "query_id", "left").select(*asked.columns, F.coalesce(least - F.abs(least) * 1e-15, F.lit(float("-inf"))).alias("kth"))
        part = searched(blocks_of(due(bounded, space, start, stop), block_rows), forest, k)
        found = cut(best(part if found is None else found.unionByName(part), k).drop("rank"))
        start, stop = stop, 4 * stop
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
