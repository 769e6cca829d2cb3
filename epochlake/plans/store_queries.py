"""Queries on the way from recordings to stores: routing, malformed recordings, caps, parts, names and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epochlake.functions import batches, decompose, features as ft
from epochlake.functions.arrays import mean
from epochlake.operators import epochs, joins, matching
from epochlake.sources import stores

from .common import CH, CHANNELS, EP, R, Queries, channel_epochs, event_epochs, read, recordings
from .epoch_queries import MAD, PTP
from .feature_queries import BAND_SQL, FS, WINDOW, E, store

Q = Queries()


@Q.add("route_stores", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'main' WHEN 'O' THEN 'main' ELSE 'undetermined' END AS store, (CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END)::INT AS label FROM orders")
def route_stores(spark, sf_dir):
    """Three diagnoses to two stores: yes and no to one, what is undetermined to another, with label 1."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return joins.routed(o, "o_orderstatus", {"F": ("main", 1), "O": ("main", 0)}, ("undetermined", 1)).select("o_orderkey", "store", "label")


_TYPES = "(SELECT count(DISTINCT event_type) FROM events)"


@Q.add("malformed_recordings", f"SELECT user_id AS subject, count(DISTINCT event_type) AS n_channels, count(DISTINCT event_type) <> {_TYPES} AS malformed FROM events GROUP BY user_id")
def malformed_recordings(spark, sf_dir):
    """Recordings that lack one of the channels, or have another."""
    wanted = [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().collect()]  # the channels of the montage
    return epochs.malformed(recordings(spark, sf_dir), ["subject"], "channel", wanted).select("subject", "n_channels", "malformed")


@Q.add("adult_filter_counts", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_nationkey <> 0 AND c_acctbal < 18) AS minors, count(*) FILTER (WHERE c_nationkey = 0) AS unknown, count(*) FILTER (WHERE c_nationkey <> 0 AND c_acctbal >= 18) AS kept FROM customer GROUP BY c_mktsegment")
def adult_filter_counts(spark, sf_dir):
    """Subjects of each group that an age filter keeps and leaves out; an age may be missing."""
    c = read(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") != 0, F.col("c_acctbal")).alias("age"))
    # whose age is missing is no minor: each subject is counted once
    age = F.col("age")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(age < 18).alias("minors"), F.count_if(age.isNull()).alias("unknown"), F.count_if(age >= 18).alias("kept"))


@Q.add(
    "reject_per_trial",
    f"WITH {CH}, {PTP.format(src='ch')}, {MAD.format(g='subject, channel')} SELECT vec_id, count(*) AS n_channels, count(*) FILTER (WHERE ptp > med + 2 * mad OR ptp < 1e-9) AS n_failed, count(*) FILTER (WHERE ptp > med + 2 * mad OR ptp < 1e-9) / count(*) > 0.15 AS rejected FROM p JOIN d USING (subject, channel) GROUP BY vec_id",
)
def reject_per_trial(spark, sf_dir):
    """Rejection of trials: a finer test of flat channels, and no absolute limit."""
    return epochs.reject(channel_epochs(spark, sf_dir), ["subject", "channel"], ["vec_id"], k=2.0, flat=1e-9, max_share=0.15).drop("max_abs")


@Q.add(
    "reject_without_flat",
    f"WITH {CH}, {PTP.format(src='ch')}, {MAD.format(g='subject, channel')} SELECT vec_id, count(*) AS n_channels, count(*) FILTER (WHERE ptp > med + 2 * mad) AS n_failed, count(*) FILTER (WHERE ptp > med + 2 * mad) / count(*) > 0.15 OR max(top) > 0.4 AS rejected FROM p JOIN d USING (subject, channel) GROUP BY vec_id",
)
def reject_without_flat(spark, sf_dir):
    return epochs.reject(channel_epochs(spark, sf_dir), ["subject", "channel"], ["vec_id"], k=2.0, flat=None, limit=0.4, max_share=0.15).drop("max_abs")


_BAD = f"{CH}, s AS (SELECT subject, channel, avg(list_stddev_samp(x)) AS sd FROM ch GROUP BY subject, channel), b AS (SELECT *, median(sd) OVER (PARTITION BY subject) AS med FROM s), n AS (SELECT subject, count(*) FILTER (WHERE sd > 1.02 * med OR sd < 0.1 * med OR sd < 1e-3) AS n_bad FROM b GROUP BY subject)"


@Q.add("subjects_with_bad_channels", f"WITH {_BAD} SELECT subject, n_bad, n_bad > 1 AS skipped FROM n")
def subjects_with_bad_channels(spark, sf_dir):
    """Subjects that are skipped for having too many bad channels."""
    spread = channel_epochs(spark, sf_dir).groupBy("subject", "channel").agg(F.avg(F.sqrt(ft.variance(F.col("x")))).alias("sd"))
    bad = epochs.bad_channels(spread, ["subject"], "sd", high=1.02)
    return epochs.too_bad(bad, ["subject"], 1)


@Q.add(
    "capped_rejection",
    f"""WITH {R}, {EP}, two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY epoch) AS n FROM ep) WHERE n <= 6), {PTP.format(src='two')}, {MAD.format(g='subject')},
k AS (SELECT subject, epoch, row_number() OVER (PARTITION BY subject ORDER BY epoch) AS n FROM p JOIN d USING (subject) WHERE NOT (ptp > med + 1.5 * mad OR ptp < 1e-6)) SELECT subject, epoch FROM k WHERE n <= 3""",
)
def capped_rejection(spark, sf_dir):
    """Rejection among the first 2 * cap epochs of a subject, then the first cap of what is left."""
    first = epochs.cap(event_epochs(spark, sf_dir), ["subject"], ["epoch"], 6)
    kept = epochs.reject(first, ["subject"], ["subject", "epoch"], k=1.5).filter("NOT rejected").select("subject", "epoch")
    return epochs.cap(kept, ["subject"], ["epoch"], 3)


@Q.add("multi_part_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority[1]::INT, o_orderkey) AS row FROM orders")
def multi_part_rows(spark, sf_dir):
    """Rows of numbered parts, one after the other: each part starts after the rows of the parts before it."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("part"))
    return joins.in_parts(o, "part", ["o_orderkey"]).select("o_orderkey", "row")


_KINDS = ["delta", "theta", "alpha", "beta"]
#: epochs of single channels under the name that the statement of band powers takes
_CH_EPOCHS = f"WITH {CH}, e AS (SELECT vec_id * 4 + list_position(['Fz', 'Cz', 'Pz', 'Oz'], channel) - 1 AS vec_id, unnest(x) AS x, unnest(range(0, len(x))) AS i FROM ch)"
_SHORT = WINDOW.replace("63", "15").replace("64", "16")
_BLOCKS = f"p AS ({BAND_SQL.replace(E, _CH_EPOCHS).replace(WINDOW, _SHORT)}), b AS (SELECT vec_id // 4 AS vec_id, ['Fz', 'Cz', 'Pz', 'Oz'][vec_id % 4 + 1] AS channel, unnest({_KINDS}) AS band, unnest([{', '.join(_KINDS)}]) AS value FROM p)"


@Q.add("block_pick", f"WITH {_BLOCKS} SELECT vec_id, concat(channel, '_', band) AS feature, round(value, 6) AS value FROM b WHERE channel IN ('Cz', 'Pz')")
def block_pick(spark, sf_dir):
    """The blocks of two channels from a vector with four values a channel, by position."""
    blocks = epochs.channel_blocks(_vector(spark, sf_dir), ["vec_id"], "v", CHANNELS, _KINDS)
    return blocks.filter(F.col("channel").isin("Cz", "Pz")).select("vec_id", "feature", "value")


def _vector(spark, sf_dir):
    """(vec_id, v): the relative band powers of each channel's whole epoch, in one array."""
    power = F.slice(batches.over(lambda x: batches.band_power(x, FS), len(batches.BAND_COLUMNS), F.col("x")), 1, len(_KINDS))
    e = channel_epochs(spark, sf_dir).select("vec_id", F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")).alias("at"), power.alias("x"))
    return e.groupBy("vec_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])).alias("v"))


@Q.add("feature_concat", f"WITH {CH}, {_BLOCKS}, l AS (SELECT vec_id, channel, ln(list_var_samp(x) + 2.220446049250313e-16) AS value FROM ch) SELECT vec_id, concat(channel, '_', band) AS feature, round(value, 6) AS value FROM b UNION ALL SELECT vec_id, concat(channel, '_logvar'), round(value, 6) FROM l")
def feature_concat(spark, sf_dir):
    """Two families of one store side by side: their named values under each other."""
    blocks = epochs.channel_blocks(_vector(spark, sf_dir), ["vec_id"], "v", CHANNELS, _KINDS).drop("channel")
    logvar = channel_epochs(spark, sf_dir).select("vec_id", F.concat("channel", F.lit("_logvar")).alias("feature"), ft.log_variance(F.col("x")).alias("value"))
    return blocks.unionByName(logvar)


@Q.add("feature_names", f"WITH {CH}, n AS (SELECT DISTINCT concat(channel, '_', unnest({_KINDS})) AS feature FROM ch) SELECT (row_number() OVER (ORDER BY list_position(['Fz', 'Cz', 'Pz', 'Oz'], feature[1:2]), list_position({_KINDS}, feature[4:])))::INT AS position, feature FROM n")
def feature_names(spark, sf_dir):
    """Names of the values of a vector, channel and kind, in the order of its blocks, for the channels that the store holds."""
    return epochs.named_blocks(channel_epochs(spark, sf_dir).select("channel").distinct(), CHANNELS, _KINDS)


@Q.add(
    "amplitude_direction",
    f"""WITH RECURSIVE {CH}, s AS (SELECT subject AS id, any_value(y) AS grp, subject % 2 AS sex, avg(vec_id) AS age FROM ch GROUP BY subject),
side AS (SELECT CASE WHEN count(*) FILTER (WHERE grp = 0) < count(*) FILTER (WHERE grp = 1) THEN 0 ELSE 1 END AS anchor FROM s),
a AS (SELECT s.*, row_number() OVER (ORDER BY md5(concat('1:', id))) AS n FROM s JOIN side ON grp = anchor), p AS (SELECT s.* FROM s JOIN side ON grp <> anchor),
m AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS anchor, NULL::BIGINT AS pick, []::BIGINT[] AS used
  UNION ALL SELECT m.n + 1, any_value(a.id), arg_min(p.id, (p.sex <> a.sex, abs(p.age - a.age), p.id)), list_append(any_value(m.used), arg_min(p.id, (p.sex <> a.sex, abs(p.age - a.age), p.id)))
  FROM m JOIN a ON a.n = m.n + 1 JOIN p ON true WHERE NOT list_contains(m.used, p.id) GROUP BY m.n),
f AS (SELECT anchor AS id FROM m WHERE n > 0 UNION ALL SELECT pick FROM m WHERE n > 0),
c AS (SELECT subject, y, vec_id, avg(ln(list_var_samp(x) + 2.220446049250313e-16)) AS v FROM ch WHERE subject IN (SELECT id FROM f) GROUP BY subject, y, vec_id),
v AS (SELECT subject, y, avg(v) AS v FROM c GROUP BY subject, y) SELECT y, count(*) AS n, round(avg(v), 6) AS level, round(stddev_samp(v), 6) AS level_sd FROM v GROUP BY y""",
)
def amplitude_direction(spark, sf_dir):
    """Log-variance over channels, then over a subject's epochs, then by class, among subjects that are matched by age and sex."""
    e = channel_epochs(spark, sf_dir)
    people = e.groupBy(F.col("subject").cast("long").alias("id")).agg(F.first("y").alias("group"), F.avg("vec_id").alias("age")).withColumn("sex", F.col("id") % 2).withColumn("cohort", F.lit(1))
    matched = matching.matched(people, "cohort", smaller_anchors=True).select(F.col("id").alias("subject"))
    kept = epochs.subset(e, matched, ["subject"]).select("subject", "y", "vec_id", ft.log_variance(F.col("x")).alias("v"))
    s = kept.groupBy("subject", "y", "vec_id").agg(F.avg("v").alias("v")).groupBy("subject", "y").agg(F.avg("v").alias("v"))
    return s.groupBy("y").agg(F.count("*").alias("n"), F.avg("v").alias("level"), F.stddev_samp("v").alias("level_sd"))


@Q.add("mode_audit")
def mode_audit(spark, sf_dir):
    """For each place of a mode, the share of epochs that don't have it: few modes make short feature rows."""
    m = decompose.modes(store(spark, sf_dir), ["vec_id"])
    return m.groupBy("imf", "mode").agg(F.count("*").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("missing"))


@Q.add("run_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def run_stamps(spark, sf_dir):
    """Time stamps as the logs write them."""
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@Q.add("resumed_store", f"WITH {CH}, f AS (SELECT channel AS cohort, 'logvar' AS family, vec_id, ln(list_var_samp(x) + 2.220446049250313e-16) AS value FROM ch UNION ALL SELECT channel, 'mean', vec_id, list_avg(x) FROM ch) SELECT cohort, family, vec_id, round(value, 6) AS value FROM f")
def resumed_store(spark, sf_dir):
    """A feature store built task by task (channel and family) in two runs, of which the second does what the first has left."""
    e = channel_epochs(spark, sf_dir)
    families = {"logvar": ft.log_variance, "mean": mean}
    work = e.select(F.col("channel").alias("cohort")).distinct().join(F.broadcast(spark.createDataFrame([(f,) for f in families], "family string")))
    path = f"{stores.folder(spark)}/resumed-{uuid.uuid4().hex}"

    def build(key):
        return e.filter(F.col("channel") == key["cohort"]).select("vec_id", families[key["family"]](F.col("x")).alias("value"))

    stores.resume(spark, path, work.filter("family = 'mean' OR cohort = 'Cz'"), build)
    stores.resume(spark, path, work, build)
    return spark.read.schema("vec_id long, value double, cohort string, family string").parquet(path).select("cohort", "family", "vec_id", "value")
