"""Windows over unbounded recordings. The batch operators have none of this; these are extensions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with a time stamp that a watermark accepts (not one without a time zone)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def time_windows(events: DataFrame, keys: list[str], value: str, length: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(keys, start, end, n, total): tumbling or sliding time windows; rows later than the watermark are dropped."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    by = timed(events, ts).withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(keys, start, end, n): sessions that end after a gap without events. In append mode one comes out once the watermark has passed its end."""
    by = timed(events, ts).withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def open_sessions(spark: SparkSession, state: str, keys: list[str]) -> DataFrame:
    """(keys, start, end, n): sessions that a finished run of sessions() in append mode has in its state, as its checkpoint folder keeps it.

    The watermark hasn't passed their end: what the run put out and these are all sessions. In append mode the state holds no others, however long the stream.
    """
    v = spark.read.format("statestore").load(state).select("value.*")
    return v.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def counted_epochs(events: DataFrame, key: str, value: str, n: int, order: str = "event_id") -> DataFrame:
    """(key, epoch, mean): epochs of n consecutive rows of each key, across micro-batches.

    The state of a key is its unfinished epoch, fewer than n values, and a counter. Rows of one
    micro-batch are taken in the order of the column, over all Arrow frames; from one micro-batch
    to the next a key's rows must arrive in order. A task holds a key's rows of one micro-batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def step(k, frames, state):
        epoch, rest = state.get if state.exists else (0, [])
        rest = list(rest)
        out = []
        rows = [pair for f in frames for pair in zip(f[order], f[value], strict=True)]
        for _, v in sorted(rows, key=lambda r: r[0]):
            rest.append(float(v))
            if len(rest) == n:
                out.append((k[0], epoch, sum(rest) / n))
                epoch, rest = epoch + 1, []
        state.update((epoch, rest))
        if out:
            yield pd.DataFrame(out, columns=[key, "epoch", "mean"])

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, epoch long, mean double", "epoch long, rest array<double>", "append", GroupStateTimeout.NoTimeout)
