"""Steps over whole recordings, which are longer than a task should hold: chunks that carry the samples around them.

A recording is segments (keys, start, x): consecutive samples from a position on, as a reader of record ranges gives them, or as
`segments` makes them of rows. A chunk takes from each segment what lies in its range or within `halo` samples of it, so a sample
is shuffled once, and those near a border twice. Filters run forward and back over chunk and halo, and what the missing rest of the recording would
change is cut off: the middle is what one pass over the recording gives.
"""

from __future__ import annotations

from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.signal import Chain


def segments(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int = 4096) -> DataFrame:
    """(keys, start, x) of rows of samples, `size` of them a segment, in their order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = rows.select(*keys, F.col(value).cast("double").alias("_v"), at.cast("long").alias("_at"))
    packed = placed.groupBy(*keys, F.floor(F.col("_at") / size).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_x"))
    return packed.select(*keys, (F.col("_s") * size).alias("start"), F.col("_x._v").alias("x"))


def totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean) of each recording: its samples, and their mean, null if one is missing or not finite."""
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    added = F.when(fine, F.aggregate("x", F.lit(0.0), lambda s, v: s + v))
    n = F.sum(F.size("x"))
    return parts.groupBy(*keys).agg(n.alias("n"), F.max(F.col("start") + F.size("x")).alias("_end"), F.when(F.count(added) == F.count("*"), F.sum(added) / n).alias("mean")).filter("n = _end").drop("_end")


def chunks(parts: DataFrame, keys: list[str], size: int, halo: int) -> DataFrame:
    """(keys, chunk, n, mean, start, x): samples start .. of each chunk of `size` with up to `halo` more on both sides.

    n and mean are the whole recording's. Recordings with a gap between segments, or a sample that is missing or not finite, are left out.
    """
    known = parts.join(totals(parts, keys).filter("mean IS NOT NULL"), keys)
    last = F.floor((F.col("n") - 1) / size)
    first_chunk = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - halo) / size))
    last_chunk = F.least(last, F.floor((F.col("start") + F.size("x") - 1 + halo) / size))
    dealt = known.filter(F.size("x") > 0).withColumn("chunk", F.explode(F.sequence(first_chunk, last_chunk)))
    low = F.greatest(F.col("start"), F.col("chunk") * size - halo)
    high = F.least(F.col("start") + F.size("x"), (F.col("chunk") + 1) * size + halo)
    # a segment just beyond the halo has nothing to give
    cut = dealt.withColumns({"_low": low, "_n": high - low}).filter("_n > 0").withColumn("_x", F.slice("x", (F.col("_low") - F.col("start") + 1).cast("int"), F.col("_n").cast("int")))
    packed = cut.groupBy(*keys, "chunk", "n", "mean").agg(F.sort_array(F.collect_list(F.struct(F.col("_low").alias("start"), F.col("_x").alias("x")))).alias("_p"))
    return packed.select(*keys, "chunk", "n", "mean", F.element_at("_p.start", 1).alias("start"), F.flatten("_p.x").alias("x"))


def epochs_of_chunk(chain: Chain, x: np.ndarray, mean: np.ndarray, start: int, n: int, low: int, high: int, length: int) -> np.ndarray:
    """(recordings, epochs, samples) of the chunk low .. high - 1 of parts that begin at `start` of recordings of n samples."""
    y, gone = chain.run(x - mean[:, None], start == 0, start + x.shape[1] == n)
    first = start * chain.p // chain.q + gone
    a, b = low * chain.p // chain.q - first, -(-min(high, n) * chain.p // chain.q) - first
    whole = (b - a) // length
    return y[:, a : a + whole * length].reshape(len(x), whole, length)


def filtered_epochs(parts: DataFrame, keys: list[str], fs: float, to: float, seconds: float, low: float | None = 0.5, high: float = 45.0, order: int = 4, mains: float | None = 50.0, chunk_seconds: float = 60.0) -> DataFrame:
    """(keys, epoch, x): recordings less their mean, resampled to rate `to`, band-passed and freed of the mains, and then cut into epochs.

    parts: segments (keys, start, x) at rate fs. Filters have no phase. An incomplete last epoch is dropped; a recording with a gap,
    or with a sample that is missing or not finite (it would spread over all of it), has no epochs.
    """
    chain = Chain(fs, to, low, high, order, mains)
    length = max(1, round(to * seconds))
    # a chunk holds whole epochs, and begins with a sample of both rates
    unit = lcm(length, chain.p)
    size = max(1, round(to * chunk_seconds / unit)) * unit * chain.q // chain.p
    per_chunk = size * chain.p // chain.q // length
    dealt = chunks(parts.select(*keys, "start", "x"), keys, size, chain.halo)

    def run(batches):
        for b in batches:
            column = {c: b.column(c).to_pylist() for c in ("chunk", "n", "mean", "start")}
            sizes = np.diff(b.column("x").offsets.to_numpy())
            flat, edges = b.column("x").flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, sizes])
            shapes: dict[tuple, list[int]] = {}
            for i, (k, n, s) in enumerate(zip(column["chunk"], column["n"], column["start"], strict=True)):
                # parts of one length at one place of their recording are one stack
                beyond = n - s - int(sizes[i])
                shapes.setdefault((int(sizes[i]), k * size - s, s == 0, beyond == 0, min(n, (k + 1) * size) - k * size), []).append(i)
            rows, epoch, values = [], [], []
            for (m, *_), at in shapes.items():
                for j in range(0, len(at), 64):
                    own = at[j : j + 64]
                    i = own[0]
                    x = np.stack([flat[edges[r] : edges[r] + m] for r in own])
                    k = column["chunk"][i]
                    found = epochs_of_chunk(chain, x, np.array([column["mean"][r] for r in own]), column["start"][i], column["n"][i], k * size, (k + 1) * size, length)
                    for r, e in zip(own, found, strict=True):
                        rows += [r] * len(e)
                        epoch += range(column["chunk"][r] * per_chunk, column["chunk"][r] * per_chunk + len(e))
                        values += list(e)
            taken = b.select(keys).take(pa.array(rows, pa.int64()))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * length, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(epoch, pa.int64()), x], names=[*keys, "epoch", "x"])

    schema = dealt.select(*keys, F.lit(0).cast("long").alias("epoch"), F.array().cast("array<double>").alias("x")).schema
    return dealt.mapInArrow(run, schema)
