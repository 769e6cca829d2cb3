"""Numeric and cell arrays of level 5 MAT-files, one row for each sample or cell, files side by side.

The format is public: a header of 128 bytes, then elements of a type, a size and data padded to 8 bytes; a matrix is
an element of elements (flags, dimensions, name, values); a compressed element is a zlib stream of one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: element types with their numpy names, and array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CELL, FIRST_NUMERIC = 1, 6


def elements(raw: bytes, order: str):
    """(type, data) of the elements of a byte string."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a small element: size and type in one word, data in the next
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, raw[at + 4 : at + 4 + size]
            at += 8
            continue
        data = raw[at + 8 : at + 8 + size]
        if len(data) < size:
            raise ValueError("the file ends inside an element")
        yield kind, data
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def array_of(raw: bytes, order: str) -> tuple[str, np.ndarray | list]:
    """(name, values) of a matrix element: numbers as an array, cells as a list in column order with .shape lost."""
    parts = list(elements(raw, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    shape = np.frombuffer(parts[1][1], order + "i4").tolist()
    name = parts[2][1].decode("ascii", "replace")
    if flags & 0xFF == CELL:
        return name, [array_of(d, order)[1] for _, d in parts[3:]]
    if flags & 0xFF < FIRST_NUMERIC:
        raise ValueError("neither numbers nor cells")
    if flags & 0x800:
        raise ValueError("complex numbers")
    kind, data = parts[3]
    return name, np.frombuffer(data, order + NUMBERS[kind]).astype(float).reshape(shape, order="F")


def decode_mat(content: bytes) -> list[tuple[str, np.ndarray | list]]:
    """The variables of a file, in its order."""
    mark = content[126:128]
    if len(content) < 128 or mark not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MAT-file")
    order = "<" if mark == b"IM" else ">"
    out = []
    for kind, data in elements(content[128:], order):
        if kind == COMPRESSED:
            kind, data = next(elements(zlib.decompress(data), order))
        if kind == MATRIX:
            out.append(array_of(data, order))
    return out


def _decoded(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(path).select("path", "content")
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(frames):
        import pandas as pd

        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows = [(p, *r, None) for r in rows_of(decode_mat(content))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows = [(p, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({n: object for n in names})

    return files.mapInPandas(run, schema)


def read_matrices(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """(path, channel, samples, error): the first variable of each .mat file, samples x channels.

    A file whose matrix hasn't exactly these channels as columns, or that can't be read, is one row with its error.
    """

    def rows(variables):
        if not variables:
            raise ValueError("no variable")
        x = variables[0][1]
        if isinstance(x, list) or x.ndim != 2 or x.shape[1] != len(channels):
            raise ValueError(f"not a matrix of {len(channels)} columns")
        return [(c, x[:, i].tolist()) for i, c in enumerate(channels)]

    return _decoded(spark, path, rows, "path string, channel string, samples array<double>, error string")


def read_cells(spark: SparkSession, path: str, cell: int, channels: list[str]) -> DataFrame:
    """(path, subject, channel, samples, error): cell number `cell` (from 1 on) of the first variable of each .mat file, an array
    of subjects x samples x channels, or of subjects x channels x samples where only that fits. Subjects are numbered from 1 on."""

    def rows(variables):
        if not variables or not isinstance(variables[0][1], list):
            raise ValueError("no cells")
        x = variables[0][1][cell - 1]
        if isinstance(x, list) or x.ndim != 3:
            raise ValueError("not an array of three dimensions")
        if x.shape[2] != len(channels):
            if x.shape[1] != len(channels):
                raise ValueError(f"no dimension of {len(channels)} channels")
            x = x.transpose(0, 2, 1)
        return [(s + 1, c, x[s, :, i].tolist()) for s in range(len(x)) for i, c in enumerate(channels)]

    return _decoded(spark, path, rows, "path string, subject int, channel string, samples array<double>, error string")


def read_trials(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """(path, part, trial, channel, samples, error): files d1.mat, d2.mat, ... of trials x channels x samples, each in its own
    numbering from 0 on; part is the number in the file's name."""

    def rows(variables):
        x = variables[0][1] if variables else None
        if x is None or isinstance(x, list) or x.ndim != 3 or x.shape[1] != len(channels):
            raise ValueError(f"not trials of {len(channels)} channels")
        return [(t, c, x[t, i].tolist()) for t in range(len(x)) for i, c in enumerate(channels)]

    from .recordings import file_number

    done = _decoded(spark, path, rows, "path string, trial int, channel string, samples array<double>, error string")
    return done.select("path", file_number(F.col("path")).alias("part"), "trial", "channel", "samples", "error")


def trials_with_labels(trials: DataFrame, labels: DataFrame) -> DataFrame:
    """trials with row, 1 .. n over all parts in their numeric order, and the columns of labels (row, ...) at that row.

    Trials without a label, or labels without a trial, mean that the two don't belong together: an error.
    """
    ends = trials.filter("error IS NULL").groupBy("part").agg((F.max("trial") + 1).alias("n"))
    # one row a file
    sizes = [(r["part"], r["n"]) for r in ends.orderBy("part").collect()]
    n, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, n))
        n += size
    if labels.count() != n:
        raise ValueError(f"{n} trials and {labels.count()} labels")
    spark = trials.sparkSession
    table = spark.createDataFrame(offsets, "part long, _before long") if offsets else spark.createDataFrame([], "part long, _before long")
    rows = trials.filter("error IS NULL").join(F.broadcast(table), "part").withColumn("row", F.col("_before") + F.col("trial") + 1).drop("_before")
    return rows.join(labels, "row")
