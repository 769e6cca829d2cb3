"""Codes of vectors: a part's nearest codebook entry, found by VA-file filtering.

Vectors become integers floor(scale * x) and are cut into consecutive parts. Each part
position has a codebook of a few entries, which starts as that part of the rows with
the smallest ids and is moved by a fixed number of rounds of means.

The nearest entry is found by a vector approximation file. Every coordinate of an entry is
quantised to a cell of a few bits; for a query, a lookup table by dimension and cell holds the
least and the largest squared distance that a coordinate of the cell may have, so sums of table
values are lower and upper bounds for each entry. Only entries whose lower bound isn't above the
smallest upper bound are refined with integer distances, ties to the lower index.

The codebooks (entries times dimensions) are all that the driver holds. A round is one pass
in which every task adds its rows up, one row a part and entry; these rows (128 a task) meet by
part and entry. Arithmetic is in 64 bits where it can't overflow, else in Python's integers.

Nulls and edge cases: rows whose vector is null or holds null or non-finite components are
dropped; vectors of no components are vectors like others
(where they have a code, it is index 0 everywhere).
Vectors of another length than that of the smallest id's vector keep their row with code, error
and label_error null, train nothing and count in no sum. Parts of lengths that can't be divided differ by one, the longer ones
first. Of rows that repeat an id the smallest vector starts an entry, and all rows train and have a code; a null id never starts one.
With fewer ids than entries the codebooks are shorter; without any id there is no codebook and codes are
null. Distances and sums beyond the range of a long count as its end. Labels that are null are equal.
An empty table gives an empty table; other columns are ignored, also those named like the result's.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up

LONG = 2**63 - 1
#: Values that one block of bounds may hold.
BLOCK = 2**21


def narrow(x: np.ndarray) -> np.ndarray:
    """An array of Python integers, in 64 bits where distances between such numbers can't leave them."""
    largest = max((abs(v) for v in x.flat), default=0)
    return x.astype(np.int64) if (2 * largest + 32) ** 2 * max(1, x.shape[1]) < 2**62 else x


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; as Python integers where distances might leave 64 bits."""
    largest = float(np.abs(x).max()) if x.size else 0.0
    if largest < 2.0**31 and (2.0 * scale * largest + 32) ** 2 * max(1, x.shape[1]) < 2.0**62:
        return np.floor(scale * x).astype(np.int64)
    # from 2**53 on a double is whole, and its multiple may be no double
    exact = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(scale * v), 1, 1)
    return exact(x.astype(object)) if x.size else x.astype(np.int64)


class Approximations:
    """Entries with their coordinates quantised to cells of `bits` bits."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        self.entries = entries
        n, dims = entries.shape
        low = entries.min(0) if n else np.zeros(dims, entries.dtype)
        width = (entries.max(0) - low) // (1 << bits) + 1 if n else np.ones(dims, entries.dtype)
        self.cell = ((entries - low) // width).astype(np.int64)
        # least and largest coordinate of each cell, ends included
        self.starts = np.array([low + c * width for c in range(1 << bits)]).reshape(1 << bits, dims)
        self.ends = self.starts + width - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distance of each row of x to each entry."""
        below, above = self.starts - x[:, None, :], x[:, None, :] - self.ends
        gap = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(-below, -above)
        lower, upper = gap * gap, reach * reach
        at = np.arange(self.cell.shape[1])
        return lower[:, self.cell, at].sum(2), upper[:, self.cell, at].sum(2)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if self.entries.dtype == object and x.dtype != object:
            x = x.astype(object)
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        off = x[row] - self.entries[entry]
        exact = (off * off).sum(1)
        # rows come in order and entries within them, so the first of the least is the lower index
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[first, len(row)])))
        chosen = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        return entry[chosen], exact[chosen]


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of a vector, as equal as they can be."""
    edges = np.cumsum([0, *(dim // parts + (k < dim % parts) for k in range(parts))]).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def assigned(x: np.ndarray, books: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), a column for each part, of rows of integers."""
    found = []
    for book, s in zip(books, cuts(x.shape[1], len(books)), strict=True):
        file = Approximations(book, bits)
        rows = max(1, BLOCK // max(1, book.size, book.shape[1] << bits))
        blocks = [file.nearest(x[at : at + rows, s]) for at in range(0, len(x), rows)]
        found.append([np.concatenate(side) for side in zip(*blocks, strict=True)])
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as doubles."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter("embedding IS NOT NULL").filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def first_books(points: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The codebooks that the rows with the smallest ids make; [] if no row has an id."""
    ids = [r[0] for r in points.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = points.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    if not rows:
        return []
    dim = len(rows[0]["v"])
    x = integers(np.array([r["v"] for r in rows if len(r["v"]) == dim], float).reshape(-1, dim), scale)
    return [x[:, s] for s in cuts(dim, parts)]


def moved(points: DataFrame, books: list[np.ndarray], scale: int, bits: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry is floor(sum / count) of the parts assigned to it; unused ones stay."""
    dim, parts = sum(b.shape[1] for b in books), len(books)
    places = cuts(dim, parts)

    def added(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            x = integers(matrix(b.column("v")), scale)
            index, _ = assigned(x, books, bits)
            for p, s in enumerate(places):
                for e in np.unique(index[:, p]).tolist():
                    rows = x[index[:, p] == e, s]
                    # a batch of 64-bit numbers below 2**31 can't overflow its sum
                    total = rows.astype(object).sum(0) if rows.dtype == object or len(rows) >= 2**31 else rows.sum(0)
                    held = sums.setdefault((p, e), [0, [0] * rows.shape[1]])
                    held[0] += len(rows)
                    held[1] = [int(a) + int(t) for a, t in zip(held[1], total, strict=True)]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()),
                 pa.array([",".join(map(str, t)) for _, t in sums.values()], pa.string())], names=["part", "entry", "n", "sums"],
            )

    def met(table):
        n, rows = sum(table.column("n").to_pylist()), [list(map(int, s.split(","))) if s else [] for s in table.column("sums").to_pylist()]
        mean = [sum(column) // n for column in zip(*rows, strict=True)]
        return pa.table({"part": table.column("part")[:1].combine_chunks(), "entry": table.column("entry")[:1].combine_chunks(), "mean": pa.array([",".join(map(str, mean))], pa.string())})

    same = points.filter(F.size("v") == dim).select("v")
    means = same.mapInArrow(added, "part int, entry int, n long, sums string").groupBy("part", "entry").applyInArrow(met, "part int, entry int, mean string")
    new = [b.tolist() for b in books]
    for r in means.collect():
        new[r["part"]][r["entry"]] = list(map(int, r["mean"].split(","))) if r["mean"] else []
    return [narrow(np.array(b, object).reshape(old.shape)) for b, old in zip(new, books, strict=True)]


def trained(points: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, bits: int = 3) -> list[np.ndarray]:
    """Codebooks, one array (entries x dimensions) of integers for each part, of kept vectors."""
    books = first_books(points, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = moved(points, books, scale, bits)
    return books


def encode(points: DataFrame, books: list[np.ndarray], scale: int = 4096, bits: int = 3) -> DataFrame:
    """points with `codes` (an index for each part) and `error`, the squared distances to those entries added up."""
    dim = sum(b.shape[1] for b in books) if books else -1

    def run(batches):
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy())
            codes, errors = [None] * b.num_rows, [None] * b.num_rows
            at = np.flatnonzero(sizes == dim)
            if len(at):
                index, distance = assigned(integers(matrix(b.column("v").take(pa.array(at))), scale), books, bits)
                total = distance.astype(object).sum(1)
                for row, i, d in zip(at.tolist(), index.tolist(), total.tolist(), strict=True):
                    codes[row], errors[row] = i, min(d, LONG)
            kept = [n for n in b.schema.names if n not in ("codes", "error")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())], names=[*kept, "codes", "error"])

    return points.mapInArrow(run, f"{points.drop('codes', 'error').schema.simpleString()[7:-1]}, codes: array<int>, error: bigint")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flatten()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row: see the docstring of the module."""
    points = cut(kept_vectors(vectors))
    books = trained(points, parts, entries, rounds, scale)
    done = cut(encode(points.select("vec_id", "label", "v"), books, scale).select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("label_key"), "codes", "error"))
    limit = F.lit(LONG).cast("decimal(38,0)")
    # without a code a row counts in no sum
    sums = done.filter("error IS NOT NULL").groupBy("label_key").agg(F.count("*").alias("n"), F.least(limit, F.sum(F.col("error").cast("decimal(38,0)"))).cast("long").alias("label_error"))
    met = looked_up(done, cut(sums), "label_key", "n", done.count())
    code = F.concat_ws("", F.transform("codes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))))
    return met.select("vec_id", F.when(F.col("codes").isNotNull(), code).alias("code"), "error", F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
