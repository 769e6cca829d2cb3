"""Cutting, cleaning and capping epochs.

A recording is rows (subject, position columns, value); an epoch store is rows
(keys, epoch, x array<double>). Groups are subjects or (subject, channel), whose
recordings are bounded; nothing here gathers more than one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlake.functions.arrays import let, mean, z_scored

#: Scale that makes a median absolute deviation estimate a standard deviation.
MAD_SCALE = 1.4826


def tumbling(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """(keys, epoch, x): consecutive epochs of n samples of each recording; an incomplete tail is dropped."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    cut = rows.withColumn("_at", at).withColumn("epoch", F.floor(F.col("_at") / n))
    packed = cut.groupBy(*keys, "epoch").agg(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("s"))
    return packed.filter(F.size("s") == n).select(*keys, "epoch", F.col("s.v").alias("x"))


def sliding(epochs: DataFrame, keys: list[str], window: int, overlap: float, x: str = "x") -> DataFrame:
    """(keys, window, x): windows over the concatenated epochs of each key, a step of window * (1 - overlap) apart, at least 1.

    Every epoch gives each window that it meets its part, so no row ever holds more than an epoch and a window.
    """
    step = max(1, int(window * (1 - overlap) + 0.5))
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    placed = epochs.select(*keys, "epoch", F.col(x).alias("_x")).withColumn("_s", F.coalesce(F.sum(F.size("_x")).over(before), F.lit(0)).cast("long"))
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_s") - window) / step) + 1), F.floor((F.col("_s") + F.size("_x") - 1) / step)
    dealt = placed.filter((F.size("_x") > 0) & (first <= last)).select(*keys, "_x", "_s", F.explode(F.sequence(first, last)).alias("window"))
    low = F.greatest(F.col("_s"), F.col("window") * step)
    n = F.least(F.col("_s") + F.size("_x"), F.col("window") * step + window) - low
    parts = dealt.select(*keys, "window", low.alias("_low"), F.slice("_x", (low - F.col("_s") + 1).cast("int"), n.cast("int")).alias("_x"))
    whole = parts.groupBy(*keys, "window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_low", "_x"))), lambda p: p["_x"])).alias("x"))
    return whole.filter(F.size("x") == window)


def peak_to_peak(x):
    return F.array_max(x) - F.array_min(x)


def scaled_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med, mad): exact median and scaled median absolute deviation, two passes."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    away = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return away.groupBy(*keys).agg(F.first("med").alias("med"), (F.median("_d") * MAD_SCALE).alias("mad"))


def reject(epochs: DataFrame, group: list[str], epoch: list[str], x: str = "x", k: float = 5.0, flat: float | None = 1e-6, limit: float | None = None, max_share: float = 0.0) -> DataFrame:
    """(epoch keys, n_channels, n_failed, max_abs, rejected), one row for each epoch.

    A channel of an epoch fails where its peak-to-peak is above median + k * scaled MAD of its
    group, or below flat. An epoch is rejected where more than max_share of its channels fail,
    or where any sample is beyond limit. max_share 0 rejects for any failing channel.
    """
    sized = epochs.withColumn("_ptp", peak_to_peak(F.col(x))).withColumn("_abs", F.array_max(F.transform(x, lambda v: F.abs(v))))
    held = sized.join(scaled_mad(sized, group, "_ptp"), group)
    bad = F.col("_ptp") > F.col("med") + k * F.col("mad")
    if flat is not None:
        bad = bad | (F.col("_ptp") < flat)
    by_epoch = held.groupBy(*epoch).agg(F.count("*").alias("n_channels"), F.count_if(bad).alias("n_failed"), F.max("_abs").alias("max_abs"))
    out = F.col("n_failed") / F.col("n_channels") > max_share
    return by_epoch.withColumn("rejected", out | (F.col("max_abs") > limit) if limit is not None else out)


def bad_channels(spread: DataFrame, keys: list[str], value: str, high: float = 5.0, low: float = 0.1, least: float = 1e-3) -> DataFrame:
    """spread (keys, channel, value) with med, the median over the channels of a key, and bad."""
    med = spread.groupBy(*keys).agg(F.median(value).alias("med"))
    v = F.col(value)
    return spread.join(med, keys).withColumn("bad", (v > high * F.col("med")) | (v < low * F.col("med")) | (v < least))


def cap(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Spark stops sorting beyond n by itself (a group limit)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def drop_sparse(df: DataFrame, subject: str, least: int) -> DataFrame:
    """Rows of subjects with at least `least` rows."""
    enough = df.groupBy(subject).count().filter(F.col("count") >= least).select(subject)
    return df.join(enough, subject, "left_semi")


def subset(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def average_reference(epochs: DataFrame, epoch: list[str], x: str = "x") -> DataFrame:
    """Every channel less the mean over the channels of its epoch, sample by sample."""
    long = epochs.select("*", F.posexplode(x).alias("_i", "_v"))
    centre = long.groupBy(*epoch, "_i").agg(F.avg("_v").alias("_m"))
    means = centre.groupBy(*epoch).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_ms"))
    return epochs.join(means, epoch).withColumn(x, F.zip_with(x, "_ms", lambda v, m: v - m)).drop("_ms")


def remove_dc(x):
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def normalised(x):
    return z_scored(x)


def channels(df: DataFrame, keys: list[str], x: str, names: list[str]) -> DataFrame:
    """Cuts an interleaved array into equal consecutive parts, one for each channel: (keys, channel, x)."""
    n = F.floor(F.size(x) / len(names)).cast("int")
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.slice(x, n * k + 1, n).alias("x")) for k, c in enumerate(names)])
    return df.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.channel", "_p.x")


def malformed(rows: DataFrame, keys: list[str], channel: str, wanted: list[str]) -> DataFrame:
    """(keys, n_channels, malformed): recordings that don't have exactly the wanted channels."""
    found = F.collect_set(channel)
    return rows.groupBy(*keys).agg(F.size(found).alias("n_channels"), (F.sort_array(found) != F.array(*map(F.lit, sorted(wanted)))).alias("malformed"))


def too_bad(bad: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n_bad, skipped): keys with more than `most` bad channels are skipped."""
    return bad.groupBy(*keys).agg(F.count_if("bad").alias("n_bad")).withColumn("skipped", F.col("n_bad") > most)


def channel_blocks(df: DataFrame, keys: list[str], vector: str, channels: list[str], kinds: list[str]) -> DataFrame:
    """(keys, channel, feature, value) of a vector that holds the values of each channel one after another, one for each kind."""
    at = [(c, k, len(kinds) * i + j) for i, c in enumerate(channels) for j, k in enumerate(kinds)]
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(f"{c}_{k}").alias("feature"), F.get(vector, F.lit(p)).alias("value")) for c, k, p in at])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def names_of(spark, channels: list[str], kinds: list[str]) -> DataFrame:
    """(position, feature): the names of such a vector's values, from 1 on."""
    return spark.createDataFrame([(len(kinds) * i + j + 1, f"{c}_{k}") for i, c in enumerate(channels) for j, k in enumerate(kinds)], "position int, feature string")


def named_blocks(channels: DataFrame, order: list[str], kinds: list[str]) -> DataFrame:
    """(position, feature): names_of() for the channels (channel) of a store, in the given order; channels that aren't in it come last, by name."""
    names = F.array(*map(F.lit, order))
    place = F.when(F.array_contains(names, F.col("channel")), F.array_position(names, F.col("channel"))).otherwise(len(order) + 1)
    each = channels.select("channel", place.alias("_c"), F.posexplode(F.array(*map(F.lit, kinds))).alias("_k", "kind"))
    at = F.row_number().over(Window.orderBy("_c", "channel", "_k"))
    return each.select(at.cast("int").alias("position"), F.concat_ws("_", "channel", "kind").alias("feature"))
