"""Exact medians of long columns, for all keys at once, by narrowing histograms instead of a sorted buffer.

Values of a key are counted in bins between their least and largest; the bin that holds a middle rank, with the least and largest
value inside it, is the next round's range, and so on until few rows are left or all are equal. A round is one pass in which a
task sends a row for each key and bin it saw. For folds, the first pass counts by fold, and what is outside a fold is the
total less the fold; only the rows of narrow ranges are ever looked at for each fold anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlake.sources.stores import held

BINS, SMALL, ROUNDS, FEW_KEYS = 1024, 4096, 10, 50_000
LARGEST = 1.7e308


def _bin(v, low, high):
    """0 .. BINS - 1, never falling with v: which bin between low and high holds it."""
    half = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)) / 2
    share = F.try_divide(half(v) - half(low), half(high) - half(low))
    return F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)).cast("int")


def _with_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(ranges) if few else ranges, keys)


def _chosen(counts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """targets (by, t, rank, below) with the bin of their rank: low, high and n of it, and below, the rows before it."""
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    met = targets.join(summed, by).filter((F.col("rank") >= F.col("below") + F.col("_before")) & (F.col("rank") < F.col("below") + F.col("_before") + F.col("c")))
    return met.select(*[c for c in targets.columns if c not in ("below", "low", "high", "n")], (F.col("below") + F.col("_before")).alias("below"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("c").alias("n"))


def medians(rows: DataFrame, keys: list[str], value: str, fold: str | None = None) -> DataFrame:
    """(keys, med), or with a column of folds (keys, fold, med) of the rows outside each fold: the mean of the two middle values.

    Missing values and NaN are left out; keys without any value have no row, and folds are those that any row has.
    """
    rows = rows.select(*keys, *([fold] if fold else []), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    own = [*keys, "_f"]
    part = rows.withColumn("_f", F.col(fold) if fold else F.lit(0))
    sizes = held(part.groupBy(*own).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    whole = sizes.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")) if keys else sizes.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 0")
    few = whole.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    if fold:
        models = whole.crossJoin(F.broadcast(sizes.select("_f").distinct()))  # a row for each fold
        models = models.join(sizes.select(*own, F.col("n").alias("_out")), own, "left").withColumn("n", F.col("n") - F.coalesce("_out", F.lit(0))).drop("_out")
    else:
        models = whole.withColumn("_f", F.lit(0))
    every = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("t"), F.floor(F.col("n") / 2).alias("rank"))))
    targets = models.filter("n > 0").select(*own, every.alias("_t")).select(*own, "_t.t", "_t.rank", F.lit(0).cast("long").alias("below"))
    # the first round: bins of all values, by fold
    ranges = whole.select(*keys, F.col("low").alias("_a"), F.col("high").alias("_b"))
    placed = _with_ranges(part, ranges, keys, few) if keys else part.crossJoin(F.broadcast(ranges))
    binned = held(placed.groupBy(*own, _bin(F.col("_v"), F.col("_a"), F.col("_b")).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    if fold:
        total = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        less = total.join(models.select(*own), keys) if keys else total.crossJoin(F.broadcast(models.select(*own)))
        counts = less.join(binned.select(*own, "bin", F.col("c").alias("_out")), [*own, "bin"], "left").withColumn("c", F.col("c") - F.coalesce("_out", F.lit(0))).filter("c > 0")
    else:
        counts = binned
    found = held(_chosen(counts.select(*own, "bin", "c", "_low", "_high"), targets, own))
    few = found.limit(FEW_KEYS + 1).count() <= FEW_KEYS

    def inside(open_: DataFrame) -> DataFrame:
        """Rows once for each open range that they lie in and whose fold they aren't of."""
        ask = open_.select(*keys, F.col("_f").alias("_m"), "t", "low", "high")
        met = _with_ranges(part, ask, keys, few) if keys else part.crossJoin(F.broadcast(ask))
        met = met.filter((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        return (met.filter(F.col("_f") != F.col("_m")) if fold else met).drop("_f").withColumnRenamed("_m", "_f")

    by = [*own, "t"]
    for _ in range(ROUNDS):
        wide = found.filter((F.col("n") > SMALL) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        counts = inside(wide).groupBy(*by, _bin(F.col("_v"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        found = held(_chosen(counts, wide.drop("low", "high", "n"), by).unionByName(found.filter((F.col("n") <= SMALL) | (F.col("low") >= F.col("high")))))
    # what is left are few rows, or few values
    left = inside(found.filter("low < high")).groupBy(*by, "_v").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = left.withColumn("_before", before).join(found.select(*by, "rank", "below"), by)
    picked = at.filter((F.col("rank") >= F.col("below") + F.col("_before")) & (F.col("rank") < F.col("below") + F.col("_before") + F.col("c"))).select(*by, "_v")
    equal = found.filter("low >= high").select(*by, F.col("low").alias("_v"))
    done = picked.unionByName(equal).groupBy(*own).agg((F.sum(F.col("_v") / 2)).alias("med"))
    return done.select(*keys, *([F.col("_f").alias(fold)] if fold else []), "med")
