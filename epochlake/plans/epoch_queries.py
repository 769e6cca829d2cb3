"""Queries that cut, clean, cap, subset and reference epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.functions import features as ft
from epochlake.functions.arrays import mean
from epochlake.operators import epochs

from .common import CH, EP, SPARSE, R, channel_epochs, event_epochs, Queries, read, recordings

Q = Queries()
PTP = "p AS (SELECT *, list_max(x) - list_min(x) AS ptp, list_max([abs(v) for v in x]) AS top FROM {src})"
MAD = "m AS (SELECT {g}, median(ptp) AS med FROM p GROUP BY {g}), d AS (SELECT {g}, any_value(med) AS med, median(abs(ptp - med)) * 1.4826::DOUBLE AS mad FROM p JOIN m USING ({g}) GROUP BY {g})"


@Q.add("tumbling_epochs", f"WITH {R}, {EP} SELECT subject, label, epoch, round(list_avg(x), 6) AS mean, round(x[1], 6) AS first, round(x[8], 6) AS last FROM ep")
def tumbling_epochs(spark, sf_dir):
    return event_epochs(spark, sf_dir).select("subject", "label", "epoch", mean(F.col("x")).alias("mean"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(7)).alias("last"))


def _sliding(percent: int) -> None:
    step = max(1, int(8 * (1 - percent / 100) + 0.5))
    sql = f"""WITH {R}, n AS (SELECT subject, (count(*) // 8) * 8 AS n FROM r GROUP BY subject),
s AS (SELECT r.subject, pos, value, n FROM r JOIN n USING (subject) WHERE pos < n),
w AS (SELECT DISTINCT subject, k AS win, k * {step} AS start FROM n, range(0, 1000) t(k) WHERE k * {step} + 8 <= n)
SELECT subject, win AS "window", round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS ptp FROM w JOIN s USING (subject) WHERE pos >= start AND pos < start + 8 GROUP BY subject, win"""

    @Q.add(f"sliding_windows_{percent}", sql)
    def run(spark, sf_dir):
        w = epochs.sliding(event_epochs(spark, sf_dir), ["subject"], 8, percent / 100)
        return w.select("subject", "window", mean(F.col("x")).alias("mean"), epochs.peak_to_peak(F.col("x")).alias("ptp"))


for _p in (0, 50, 75, 90):
    _sliding(_p)


@Q.add("epoch_count_per_subject", f"WITH {R}, {EP} SELECT subject, count(*) AS n FROM ep GROUP BY subject")
def epoch_count_per_subject(spark, sf_dir):
    return event_epochs(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))


@Q.add("epoch_count_summary", f"WITH {R}, {EP}, c AS (SELECT subject, label, count(*) AS n FROM ep GROUP BY subject, label) SELECT label, count(DISTINCT subject) AS subjects, count(*) FILTER (WHERE n < 10) AS sparse, min(n) AS least, median(n)::DOUBLE AS mid, max(n) AS most FROM c GROUP BY label")
def epoch_count_summary(spark, sf_dir):
    c = event_epochs(spark, sf_dir).groupBy("subject", "label").agg(F.count("*").alias("n"))
    return c.groupBy("label").agg(F.countDistinct("subject").alias("subjects"), F.count_if(F.col("n") < 10).alias("sparse"), F.min("n").alias("least"), F.median("n").alias("mid"), F.max("n").alias("most"))


@Q.add("drop_sparse_subjects", f"WITH {R}, {EP} SELECT subject, epoch FROM ep WHERE subject IN (SELECT subject FROM ep GROUP BY subject HAVING count(*) >= {SPARSE})")
def drop_sparse_subjects(spark, sf_dir):
    return epochs.drop_sparse(event_epochs(spark, sf_dir), "subject", SPARSE).select("subject", "epoch")


@Q.add("subject_key_subset", f"WITH {R}, {EP} SELECT subject, epoch FROM ep WHERE subject IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subject_key_subset(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject"))
    return epochs.subset(event_epochs(spark, sf_dir), keys, ["subject"]).select("subject", "epoch")


@Q.add("excluded_subjects_anti", f"WITH {R} SELECT subject, count(*) AS n FROM r WHERE subject NOT IN (3, 7, 11) GROUP BY subject")
def excluded_subjects_anti(spark, sf_dir):
    out = spark.createDataFrame([(3,), (7,), (11,)], "subject long")
    return epochs.exclude(recordings(spark, sf_dir), out, ["subject"]).groupBy("subject").agg(F.count("*").alias("n"))


@Q.add("subject_first_label", f"WITH {R} SELECT subject, arg_min(label, pos) AS label, arg_min(channel, pos) AS channel FROM r GROUP BY subject")
def subject_first_label(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return recordings(spark, sf_dir).groupBy("subject").agg(F.min_by("label", order).alias("label"), F.min_by("channel", order).alias("channel"))


@Q.add("scaled_mad", f"WITH {R}, m AS (SELECT subject, median(value) AS med FROM r GROUP BY subject) SELECT subject, round(any_value(med), 6) AS med, round(median(abs(value - med)) * 1.4826, 6) AS mad FROM r JOIN m USING (subject) GROUP BY subject")
def scaled_mad(spark, sf_dir):
    return epochs.scaled_mad(recordings(spark, sf_dir), ["subject"], "value")


@Q.add("robust_mad_reject", f"WITH {R}, {EP}, {PTP.format(src='ep')}, {MAD.format(g='subject')} SELECT subject, epoch, round(top, 6) AS max_abs, ptp > med + 1.5 * mad OR ptp < 1e-6 AS rejected FROM p JOIN d USING (subject)")
def robust_mad_reject(spark, sf_dir):
    return epochs.reject(event_epochs(spark, sf_dir), ["subject"], ["subject", "epoch"], k=1.5).select("subject", "epoch", "max_abs", "rejected")


_FAILED = f"""WITH {CH}, {PTP.format(src="ch")}, {MAD.format(g="subject, channel")},
e AS (SELECT vec_id, subject, count(*) AS n_channels, count(*) FILTER (WHERE ptp > med + 2 * mad OR ptp < 1e-6) AS n_failed, max(top) AS max_abs FROM p JOIN d USING (subject, channel) GROUP BY vec_id, subject)"""


@Q.add("multichannel_reject_fraction", f"{_FAILED} SELECT vec_id, n_channels, n_failed, round(max_abs, 6) AS max_abs, n_failed / n_channels > 0.15 OR max_abs > 0.4 AS rejected FROM e")
def multichannel_reject_fraction(spark, sf_dir):
    return epochs.reject(channel_epochs(spark, sf_dir), ["subject", "channel"], ["vec_id"], k=2.0, limit=0.4, max_share=0.15)


_SPREAD = f"{CH}, s AS (SELECT vec_id, channel, list_stddev_samp(x) AS sd FROM ch), b AS (SELECT *, median(sd) OVER (PARTITION BY vec_id) AS med FROM s), f AS (SELECT vec_id, channel, round(sd, 6) AS sd, round(med, 6) AS med, sd > 1.3 * med OR sd < 0.1 * med OR sd < 1e-3 AS bad FROM b)"


@Q.add("bad_channel_detect", f"WITH {_SPREAD} SELECT * FROM f")
def bad_channel_detect(spark, sf_dir):
    sd = F.sqrt(ft.variance(F.col("x")))
    spread = channel_epochs(spark, sf_dir).select("vec_id", "channel", sd.alias("sd"))
    return epochs.bad_channels(spread, ["vec_id"], "sd", high=1.3)


@Q.add(
    "good_channel_reject",
    f"""WITH {_SPREAD}, g AS (SELECT ch.* FROM ch JOIN f USING (vec_id, channel) WHERE NOT bad), {PTP.format(src="g")}, {MAD.format(g="subject, channel")}
SELECT vec_id, count(*) AS n_channels, count(*) FILTER (WHERE ptp > med + 2 * mad OR ptp < 1e-6) AS n_failed, round(max(top), 6) AS max_abs,
  count(*) FILTER (WHERE ptp > med + 2 * mad OR ptp < 1e-6) / count(*) > 0.15 AS rejected FROM p JOIN d USING (subject, channel) GROUP BY vec_id""",
)
def good_channel_reject(spark, sf_dir):
    store = channel_epochs(spark, sf_dir)
    bad = bad_channel_detect(spark, sf_dir).filter("bad")
    return epochs.reject(epochs.exclude(store, bad, ["vec_id", "channel"]), ["subject", "channel"], ["vec_id"], k=2.0, max_share=0.15)


@Q.add("cap_first_n", f"WITH {R}, {EP} SELECT subject, epoch FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY epoch) AS n FROM ep) WHERE n <= 3")
def cap_first_n(spark, sf_dir):
    return epochs.cap(event_epochs(spark, sf_dir), ["subject"], ["epoch"], 3).select("subject", "epoch")


@Q.add(
    "average_reference",
    f"""WITH {CH}, l AS (SELECT vec_id, channel, unnest(x) AS v, unnest(range(0, 16)) AS i FROM ch), c AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id, i) AS w FROM l)
SELECT vec_id, channel, round(sum(abs(w)), 6) AS abs_sum, round(arg_min(w, i), 6) AS first FROM c GROUP BY vec_id, channel""",
)
def average_reference(spark, sf_dir):
    done = epochs.average_reference(channel_epochs(spark, sf_dir), ["vec_id"])
    return done.select("vec_id", "channel", F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v)).alias("abs_sum"), F.get("x", F.lit(0)).alias("first"))


@Q.add("remove_dc", f"WITH {R}, {EP} SELECT subject, epoch, round(x[1] - list_avg(x), 6) AS first, round(list_max(x) - list_avg(x), 6) AS top FROM ep")
def remove_dc(spark, sf_dir):
    done = event_epochs(spark, sf_dir).withColumn("x", epochs.remove_dc(F.col("x")))
    return done.select("subject", "epoch", F.get("x", F.lit(0)).alias("first"), F.array_max("x").alias("top"))


@Q.add("normalise_epoch", f"WITH {R}, {EP} SELECT subject, epoch, round((x[1] - list_avg(x)) / (list_stddev_samp(x) + 2.220446049250313e-16), 6) AS first FROM ep")
def normalise_epoch(spark, sf_dir):
    return event_epochs(spark, sf_dir).select("subject", "epoch", F.get(epochs.normalised(F.col("x")), F.lit(0)).alias("first"))


@Q.add("participant_predicate", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 18 AND c_nationkey % 2 = 1")
def participant_predicate(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 18) & (F.col("c_nationkey") % 2 == 1)).select("c_custkey", "c_name")


@Q.add("limit_per_group", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n <= 12")
def limit_per_group(spark, sf_dir):
    return epochs.cap(read(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"], 12).select("c_custkey", "c_mktsegment")


@Q.add("positional_label_join", "WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings), l AS (SELECT user_id % 3 AS code, row_number() OVER (ORDER BY ts, event_id) AS rid FROM events) SELECT vec_id, code FROM n JOIN l USING (rid)")
def positional_label_join(spark, sf_dir):
    from epochlake.operators.joins import numbered

    left = numbered(read(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"])
    right = numbered(read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("code"), "ts", "event_id"), ["ts", "event_id"])
    return left.join(right, "row").select("vec_id", "code")
