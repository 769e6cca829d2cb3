"""Queries of signal steps and of families that run in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochlake.functions import batches, decompose, signal
from epochlake.operators import recordings

from .common import Queries, channel_epochs, read
from .feature_queries import BAND_SQL, FS, store

Q = Queries()


FAMILY_SQL = {"welch_bands": f"SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in batches.BAND_COLUMNS[:5])} FROM ({BAND_SQL})"}


def _family(name: str) -> None:
    @Q.add(f"{name}_family", FAMILY_SQL.get(name))
    def run(spark, sf_dir):
        v = store(spark, sf_dir).select("vec_id", signal.family(name, F.col("x"), FS).alias("v"))
        return v.select("vec_id", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(signal.FAMILIES[name][0])])


for _n in signal.FAMILIES:
    _family(_n)


def _covariance(kind: str) -> None:
    @Q.add(f"log_covariance_{kind}")
    def run(spark, sf_dir):
        e = channel_epochs(spark, sf_dir).groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "x"))), lambda s: s["x"]).alias("xs"))
        return e.select("vec_id", F.posexplode(batches.log_covariances(F.col("xs"), kind)).alias("position", "value"))


for _k in ("full", "diag", "offdiag", "corr"):
    _covariance(_k)


@Q.add("filter_and_resample")
def filter_and_resample(spark, sf_dir):
    clean = batches.over(lambda x: signal.resampled(signal.cleaned(x, FS), FS, FS / 2), None, F.col("x"))
    done = store(spark, sf_dir).select("vec_id", clean.alias("x"))
    return done.select("vec_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("energy"))


@Q.add("mode_phase_space")
def mode_phase_space(spark, sf_dir):
    """Phase-space features of every mode of every epoch; null where an epoch hasn't the mode."""
    m = decompose.modes(store(spark, sf_dir), ["vec_id"])
    f = m.select("vec_id", "imf", "mode", batches.over(batches.phase_space, len(batches.PSR2), F.col("x"), batches.phase_space_room).alias("p"), batches.over(batches.phase_space_3d, len(batches.PSR3), F.col("x"), batches.phase_space_room).alias("q"))
    return f.select("vec_id", "imf", "mode", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(batches.PSR2)], *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(batches.PSR3)])


# --- recordings: the vectors of a label, one after another, are the samples of one channel


def _segments(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("channel"), (at * F.size("embedding")).cast("long").alias("start"), F.col("embedding").cast("array<double>").alias("x"))


def _samples(e):
    return e.select("channel", "epoch", F.posexplode("x").alias("position", "value"))


_TAPS = ", ".join(f"({k - 20}, {float(v)!r}::DOUBLE)" for k, v in enumerate(signal.resampling_filter(1, 2)))


@Q.add(
    "recording_resampled",
    f"""WITH s AS (SELECT label AS channel, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS start, embedding FROM embeddings),
x AS (SELECT channel, start + i AS pos, embedding[i + 1]::DOUBLE AS v FROM s, range(0, 64) r(i)), c AS (SELECT channel, avg(v) AS mean, count(*) AS n FROM x GROUP BY channel),
h(k, tap) AS (VALUES {_TAPS}),
y AS (SELECT channel, (pos + k) // 2 AS m, sum((v - mean) * tap) AS v FROM x JOIN c USING (channel), h WHERE (pos + k) % 2 = 0 AND pos + k >= 0 AND pos + k < n GROUP BY channel, (pos + k) // 2)
SELECT channel, m // 64 AS epoch, (m % 64)::INT AS position, round(v, 6) AS value FROM y JOIN c USING (channel) WHERE m // 64 < (n + 1) // 2 // 64""",
)
def recording_resampled(spark, sf_dir):
    """Recordings at half their rate, cut into epochs of a second."""
    return _samples(recordings.filtered_epochs(_segments(spark, sf_dir), ["channel"], FS, FS / 2, 1.0, low=None, mains=None))


@Q.add("recording_epochs")
def recording_epochs(spark, sf_dir):
    """Epochs of two seconds of recordings that were resampled, band-passed and freed of the mains before they were cut."""
    return _samples(recordings.filtered_epochs(_segments(spark, sf_dir), ["channel"], FS, FS / 2, 2.0))
