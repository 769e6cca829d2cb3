"""Queries for folds, scaling, metrics, tests and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.functions import batches
from epochlake.functions import features as ft
from epochlake.functions.arrays import mean
from epochlake.operators import folds, joins, metrics, statistics

from .common import CH, EP, R, Queries, channel_epochs, event_epochs, read, recordings
from .feature_queries import FS, PSD, WINDOW

Q = Queries()
K = 5
SUB = "sub AS (SELECT DISTINCT user_id AS subject, (user_id % 2)::INT AS label FROM events)"
FOLDS = f"{SUB}, folds AS (SELECT subject, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat('1:', subject)), subject) - 1) % {K} + 1)::INT AS fold FROM sub)"
#: predictions: labelled documents scored by length
PRED = "pred AS (SELECT l.doc_id, d.lang, d.source, l.toxic AS y, (d.n_chars > 1500)::INT AS yhat, d.n_chars / 10000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"
#: long features of suppliers
FEAT = """feat AS (SELECT l_suppkey AS subject, s_nationkey % 2 AS y, f AS feature, v AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey,
  LATERAL (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS f, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v))"""
MOMENTS = "mom AS (SELECT {k}, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0, var_samp(value) FILTER (WHERE y = 1) AS v1, var_samp(value) FILTER (WHERE y = 0) AS v0 FROM {src} GROUP BY {k})"
MEANS = "mean AS (SELECT subject, y, feature, avg(value) AS value FROM feat GROUP BY subject, y, feature)"


def subjects(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), (F.col("user_id") % 2).cast("int").alias("label")).distinct()


def grouped(spark, sf_dir):
    return folds.grouped_folds(subjects(spark, sf_dir), "subject", "label", K, 1)


def predictions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")).join(docs, "doc_id")
    return p.select("doc_id", "lang", "source", "y", (F.col("n_chars") > 1500).cast("int").alias("yhat"), (F.col("n_chars") / 10000.0).alias("score"))


def supplier_features(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("value")) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))])
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") % 2).alias("y"))
    return li.select(F.col("l_suppkey").alias("subject"), F.explode(parts).alias("p")).join(s, "subject").select("subject", "y", "p.feature", "p.value")


def supplier_means(spark, sf_dir):
    return supplier_features(spark, sf_dir).groupBy("subject", "y", "feature").agg(F.avg("value").alias("value"))


@Q.add("grouped_folds", f"WITH {FOLDS} SELECT * FROM folds")
def grouped_folds(spark, sf_dir):
    return grouped(spark, sf_dir)


@Q.add("row_folds", f"WITH {R}, {EP} SELECT subject, label, epoch, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat('2:', subject, ':', epoch)), subject, epoch) - 1) % {K} + 1)::INT AS fold FROM ep")
def row_folds(spark, sf_dir):
    return folds.row_folds(event_epochs(spark, sf_dir).select("subject", "label", "epoch"), ["subject", "epoch"], "label", K, 2)


@Q.add(
    "stratified_subsample",
    f"WITH {R}, {EP}, q AS (SELECT label, floor(count(*) * 300 / (SELECT count(*) FROM ep)::DOUBLE + 0.5) AS q FROM ep GROUP BY label), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('3:', subject, ':', epoch)), subject, epoch) AS n FROM ep) SELECT subject, label, epoch FROM n JOIN q USING (label) WHERE n <= q",
)
def stratified_subsample(spark, sf_dir):
    rows = event_epochs(spark, sf_dir).select("subject", "label", "epoch")
    return folds.stratified_sample(rows, ["subject", "epoch"], "label", 300, 3).select("subject", "label", "epoch")


@Q.add("validation_split", f"WITH {SUB}, n AS (SELECT subject, row_number() OVER (ORDER BY md5(concat('4:', subject)), subject) AS n, count(*) OVER () AS c FROM sub) SELECT subject, n <= greatest(2, floor(0.15 * c + 0.5)) AS validation FROM n")
def validation_split(spark, sf_dir):
    return folds.validation_split(subjects(spark, sf_dir), "subject", 0.15, 4)


_LONG = f"""{R}, {EP}, {FOLDS},
long AS (SELECT subject, epoch, 'mean' AS feature, list_avg(x) AS value FROM ep UNION ALL SELECT subject, epoch, 'top', CASE WHEN list_max(x) < 60 THEN list_max(x) END FROM ep),
tr AS (SELECT k.fold, l.* FROM long l JOIN folds f USING (subject) JOIN (SELECT DISTINCT fold FROM folds) k ON f.fold <> k.fold),
med AS (SELECT fold, feature, coalesce(median(value), 0) AS med FROM tr GROUP BY fold, feature),
st AS (SELECT t.fold, t.feature, any_value(med) AS med, avg(coalesce(value, med)) AS mean, stddev_samp(coalesce(value, med)) AS sd0 FROM tr t JOIN med m ON t.fold = m.fold AND t.feature = m.feature GROUP BY t.fold, t.feature),
stat AS (SELECT fold, feature, med, mean, CASE WHEN coalesce(sd0, 0) < 1e-12 THEN 1 ELSE sd0 END AS sd FROM st)"""


def long_features(spark, sf_dir):
    e = event_epochs(spark, sf_dir)
    top = F.array_max("x")
    parts = F.array(F.struct(F.lit("mean").alias("feature"), mean(F.col("x")).alias("value")), F.struct(F.lit("top").alias("feature"), F.when(top < 60, top).alias("value")))
    return e.select("subject", "epoch", F.explode(parts).alias("p")).select("subject", "epoch", "p.feature", "p.value")


@Q.add("impute_median", f"WITH {_LONG} SELECT fold, feature, round(med, 6) AS med, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stat")
def impute_median(spark, sf_dir):
    return folds.training_statistics(long_features(spark, sf_dir), grouped(spark, sf_dir), "subject")


@Q.add("zscore_in_fold", f"WITH {_LONG} SELECT l.subject, epoch, s.fold, l.feature, round((coalesce(value, med) - mean) / sd, 6) AS z FROM long l JOIN stat s ON l.feature = s.feature")
def zscore_in_fold(spark, sf_dir):
    long = long_features(spark, sf_dir)
    return folds.scaled(long, folds.training_statistics(long, grouped(spark, sf_dir), "subject")).select("subject", "epoch", "fold", "feature", "z")


@Q.add(
    "age_residualise",
    f"""WITH {FOLDS}, c AS (SELECT c_custkey AS subject, (c_nationkey + 18)::DOUBLE AS age, c_acctbal AS value, fold FROM customer JOIN folds ON subject = c_custkey),
l AS (SELECT k.fold, regr_slope(value, age) AS b, regr_intercept(value, age) AS a FROM c JOIN (SELECT DISTINCT fold FROM folds) k ON c.fold <> k.fold GROUP BY k.fold)
SELECT subject, c.fold, round(value - a - b * age, 4) AS residual FROM c JOIN l ON c.fold = l.fold""",
)
def age_residualise(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_nationkey") + 18).cast("double").alias("age"), F.col("c_acctbal").alias("value"))
    return folds.age_residuals(c, grouped(spark, sf_dir), "subject", "age", "value").select("subject", "fold", F.round("residual", 4).alias("residual"))


_CONF = """n AS (SELECT {k}, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND yhat <> 1) AS tn, count(*) FILTER (WHERE y <> 1 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat <> 1) AS fn FROM {src} GROUP BY {k}),
c AS (SELECT *, tp / greatest(tp + fn, 1) AS s1, tn / greatest(tn + fp, 1) AS s0, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM n)
SELECT {k}, tp, tn, fp, fn, round(100 * (tp + tn) / greatest(tp + tn + fp + fn, 1), 6) AS acc, round(100 * s1, 6) AS sen, round(100 * s0, 6) AS spe, round(50 * (s1 + s0), 6) AS bal,
  round(100 * tp / greatest(tp + fp, 1), 6) AS ppv, round(100 * 2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round(CASE WHEN den > 0 THEN (tp * tn - fp * fn) / den ELSE 0 END, 6) AS mcc FROM c"""


@Q.add("confusion_metrics", f"WITH {PRED}, {_CONF.format(k='lang', src='pred')}")
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["lang"])


_AUC = "(sum(rk) FILTER (WHERE {y} = 1) - count(*) FILTER (WHERE {y} = 1) * (count(*) FILTER (WHERE {y} = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE {y} = 1) * count(*) FILTER (WHERE {y} <> 1), 0)"
_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {s}) + (count(*) OVER (PARTITION BY {k}, {s}) - 1) / 2 AS rk"


@Q.add("roc_auc", f"WITH {PRED}, r AS (SELECT *, {_RANK.format(k='lang', s='score')} FROM pred) SELECT lang, round({_AUC.format(y='y')}, 6) AS auc FROM r GROUP BY lang")
def roc_auc(spark, sf_dir):
    return metrics.auc(predictions(spark, sf_dir), ["lang"])


_VOTE = f"""{R}, {EP}, p AS (SELECT subject, label AS y, (list_avg(x) > 50)::INT AS yhat, list_avg(x) / 100 AS score FROM ep),
v AS (SELECT subject, any_value(y) AS y, CASE WHEN avg(yhat) = 0.5 THEN avg(score) > 0.5 ELSE avg(yhat) > 0.5 END::INT AS yhat, avg(score) AS score FROM p GROUP BY subject)"""


def epoch_predictions(spark, sf_dir):
    m = mean(F.col("x"))
    return event_epochs(spark, sf_dir).select("subject", F.col("label").alias("y"), "epoch", (m > 50).cast("int").alias("yhat"), (m / 100).alias("score"))


@Q.add("subject_vote", f"WITH {_VOTE} SELECT subject, y, yhat, round(score, 12) AS score FROM v", digits=12)
def subject_vote(spark, sf_dir):
    return metrics.vote(epoch_predictions(spark, sf_dir), ["subject"])


@Q.add("class_weights", f"WITH {PRED} SELECT y, count(*) AS n, round((SELECT count(*) FROM pred) / (2.0 * count(*)), 6) AS weight FROM pred GROUP BY y")
def class_weights(spark, sf_dir):
    p = predictions(spark, sf_dir)
    total = p.agg(F.count("*").alias("_t"))
    return p.groupBy("y").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("y", "n", (F.col("_t") / (2.0 * F.col("n"))).alias("weight"))


@Q.add(
    "metric_mean_sd",
    f"WITH {PRED}, {_CONF.format(k='lang, source', src='pred').replace('SELECT lang, source, tp', ', m AS (SELECT lang, source, tp', 1)}) SELECT lang, round(avg(bal), 4) AS bal, round(coalesce(stddev_samp(bal), 0), 4) AS bal_sd, round(avg(acc), 4) AS acc, round(coalesce(stddev_samp(acc), 0), 4) AS acc_sd FROM m GROUP BY lang",
)
def metric_mean_sd(spark, sf_dir):
    m = metrics.mean_sd(metrics.confusion(predictions(spark, sf_dir), ["lang", "source"]), ["lang"], ["bal", "acc"])
    return m.select("lang", *[F.round(c, 4).alias(c) for c in ("bal", "bal_sd", "acc", "acc_sd")])


_T = "coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 0), 0)"


@Q.add("pooled_t_rank", f"WITH {FEAT}, {MEANS}, {MOMENTS.format(k='feature', src='mean')}, t AS (SELECT feature, {_T} AS t FROM mom) SELECT feature, round(t, 6) AS t, row_number() OVER (ORDER BY abs(t) DESC, feature)::INT AS rank FROM t")
def pooled_t_rank(spark, sf_dir):
    m = statistics.pooled_t(statistics.two_groups(supplier_means(spark, sf_dir), ["feature"], "y", "value"))
    return statistics.top_features(m, "feature", 100).select("feature", "t", "rank")


@Q.add("select_top_k", f"WITH {FEAT}, {MEANS}, {MOMENTS.format(k='feature', src='mean')}, t AS (SELECT feature, {_T} AS t FROM mom) SELECT feature FROM t ORDER BY abs(t) DESC, feature LIMIT 2")
def select_top_k(spark, sf_dir):
    m = statistics.pooled_t(statistics.two_groups(supplier_means(spark, sf_dir), ["feature"], "y", "value"))
    return statistics.top_features(m, "feature", 2).select("feature")


@Q.add("welch_t", f"WITH {FEAT}, {MEANS}, {MOMENTS.format(k='feature', src='mean')} SELECT feature, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM mom")
def welch_t(spark, sf_dir):
    m = statistics.welch(statistics.two_groups(supplier_means(spark, sf_dir), ["feature"], "y", "value"))
    return m.select("feature", "n1", "n0", "t", F.round("df", 4).alias("df"))


# tails by Simpson's rule over an angle: t = sqrt(df) tan(angle), and cos(angle)^2 = d2 / (d2 + d1 f)
_SIMPSON = "(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
T_TAIL = f"2 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi()) * (pi() / 2 - atan(any_value(abs(t)) / sqrt(any_value(df)))) / 6000 * sum({_SIMPSON} * pow(greatest(cos(atan(abs(t) / sqrt(df)) + (pi() / 2 - atan(abs(t) / sqrt(df))) * i / 2000), 0), df - 1))"


@Q.add("welch_p", f"WITH {FEAT}, {MEANS}, {MOMENTS.format(k='feature', src='mean')}, w AS (SELECT feature, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM mom) SELECT feature, round(any_value(t), 6) AS t, round({T_TAIL}, 6) AS p FROM w, range(0, 2001) r(i) GROUP BY feature")
def welch_p(spark, sf_dir):
    m = statistics.welch(statistics.two_groups(supplier_means(spark, sf_dir), ["feature"], "y", "value"))
    return statistics.with_p(m).select("feature", "t", "p")


@Q.add("cohen_d", f"WITH {FEAT}, {MEANS}, {MOMENTS.format(k='feature', src='mean')} SELECT feature, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS d FROM mom")
def cohen_d(spark, sf_dir):
    return statistics.cohen_d(statistics.two_groups(supplier_means(spark, sf_dir), ["feature"], "y", "value")).select("feature", "d")


_P = "p AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1000) / 20000.0::DOUBLE + CASE WHEN p_size > 10 THEN 0.2 ELSE 0 END AS p FROM part)"


@Q.add("bh_select", f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rank, count(*) OVER () AS m FROM p), l AS (SELECT coalesce(max(rank) FILTER (WHERE p <= rank / m * 0.05), 0) AS last FROM r) SELECT k, rank::INT AS rank, rank <= last AS selected FROM r, l")
def bh_select(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 1000 / F.lit(20000.0) + F.when(F.col("p_size") > 10, 0.2).otherwise(0.0)).alias("p"))
    return statistics.benjamini_hochberg(p, "k").select("k", "rank", "selected")


# the same query under the name it had while bh_select read a part of the table
Q.also("bh_select_all", "bh_select")


_ANOVA = """g AS (SELECT c_nationkey % 5 AS region, c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, coalesce(var_samp(c_acctbal), 0) AS v FROM customer GROUP BY 1, 2),
s AS (SELECT region, count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum((n - 1) * v) AS w FROM g GROUP BY region)
SELECT region, k, n::BIGINT AS n, (q - s * s / n) / (k - 1) / (w / (n - k)) AS f FROM s"""


@Q.add("anova_f", f"WITH a AS (WITH {_ANOVA}) SELECT region, k, n, round(f, 6) AS f FROM a")
def anova_f(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("region"), "c_mktsegment", "c_acctbal")
    return statistics.anova(c, ["region"], "c_mktsegment", "c_acctbal").select("region", "k", "n", "f")


_F_ANGLE = "acos(sqrt((n - k) / ((n - k) + (k - 1) * f)))"


@Q.add(
    "anova_p",
    f"""WITH a AS (WITH {_ANOVA}) SELECT region, any_value(k) AS k, any_value(n) AS n, round(any_value(f), 6) AS f,
  round(2 * exp(lgamma(any_value(n - 1) / 2.0) - lgamma(any_value(n - k) / 2.0) - lgamma(any_value(k - 1) / 2.0)) * (pi() / 2 - any_value({_F_ANGLE})) / 6000
  * sum({_SIMPSON} * pow(greatest(cos({_F_ANGLE} + (pi() / 2 - {_F_ANGLE}) * i / 2000), 0), n - k - 1) * pow(sin({_F_ANGLE} + (pi() / 2 - {_F_ANGLE}) * i / 2000), k - 2)), 6) AS p FROM a, range(0, 2001) r(i) GROUP BY region""",
)
def anova_p(spark, sf_dir):
    return statistics.anova_p(anova_f(spark, sf_dir))


@Q.add("pearson_age", "SELECT c_mktsegment, count(*) AS n, round(corr(c_nationkey::DOUBLE, c_acctbal), 6) AS r FROM customer GROUP BY c_mktsegment")
def pearson_age(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.corr(F.col("c_nationkey").cast("double"), "c_acctbal").alias("r"))


@Q.add("pearson_p", f"WITH c AS (SELECT c_mktsegment, count(*) AS n, corr(c_nationkey::DOUBLE, c_acctbal) AS r FROM customer GROUP BY c_mktsegment), w AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM c) SELECT c_mktsegment, any_value(n) AS n, round(any_value(r), 6) AS r, round({T_TAIL}, 6) AS p FROM w, range(0, 2001) x(i) GROUP BY c_mktsegment")
def pearson_p(spark, sf_dir):
    """Correlation and its two-sided p; one row a group."""
    return statistics.correlation_p(pearson_age(spark, sf_dir), "r", "n")


_TOPO = f"""{CH}, lv AS (SELECT subject, y, channel, avg(ln(list_var_samp(x) + 2.220446049250313e-16)) AS value, any_value(subject % 7)::DOUBLE AS age FROM ch GROUP BY subject, y, channel)"""


def channel_levels(spark, sf_dir):
    e = channel_epochs(spark, sf_dir).select("subject", "y", "channel", ft.log_variance(F.col("x")).alias("v"))
    return e.groupBy("subject", "y", "channel").agg(F.avg("v").alias("value"), (F.first("subject") % 7).cast("double").alias("age"))


@Q.add("channel_topography", f"WITH {_TOPO}, {MOMENTS.format(k='channel', src='lv')}, r AS (SELECT *, {_RANK.format(k='channel', s='round(value, 9)')} FROM lv), a AS (SELECT channel, {_AUC.format(y='y')} AS auc, corr(value, age) AS r FROM r GROUP BY channel) SELECT channel, round(m1, 6) AS m1, round(m0, 6) AS m0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS d, round(auc, 6) AS auc, round(r, 6) AS r_age FROM mom JOIN a USING (channel)")
def channel_topography(spark, sf_dir):
    lv = channel_levels(spark, sf_dir)
    d = statistics.cohen_d(statistics.two_groups(lv, ["channel"], "y", "value")).select("channel", "m1", "m0", "d")
    r = lv.groupBy("channel").agg(F.corr("value", "age").alias("r_age"))
    return d.join(metrics.auc(lv.withColumn("value", F.round("value", 9)), ["channel"], score="value"), "channel").join(r, "channel")


@Q.add("single_feature_auc", f"WITH {FEAT}, {MEANS}, r AS (SELECT *, {_RANK.format(k='feature', s='round(value, 9)')} FROM mean), a AS (SELECT feature, {_AUC.format(y='y')} AS a FROM r GROUP BY feature HAVING max(value) > min(value)) SELECT feature, round(greatest(a, 1 - a), 6) AS auc FROM a")
def single_feature_auc(spark, sf_dir):
    # means that tie in exact arithmetic may differ in the last bit
    m = supplier_means(spark, sf_dir).withColumn("value", F.round("value", 9))
    varied = m.groupBy("feature").agg((F.max("value") > F.min("value")).alias("_v")).filter("_v").select("feature")
    a = metrics.auc(m, ["feature"], score="value").join(varied, "feature", "left_semi")
    return a.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


@Q.add("group_demographics", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS age, round(stddev_samp(c_acctbal), 4) AS age_sd, round(100 * avg((c_nationkey % 2 = 1)::INT), 6) AS male FROM customer GROUP BY c_mktsegment")
def group_demographics(spark, sf_dir):
    male = F.avg((F.col("c_nationkey") % 2 == 1).cast("double")) * 100
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("age"), F.round(F.stddev_samp("c_acctbal"), 4).alias("age_sd"), male.alias("male"))


@Q.add("season_group_means", "WITH g AS (SELECT c_mktsegment, c_nationkey % 4 AS season, count(*) AS n, floor(avg(c_acctbal))::BIGINT AS m FROM customer GROUP BY 1, 2) SELECT c_mktsegment, string_agg(concat(season, ':', m, '(', n, ')'), ', ' ORDER BY season) AS means FROM g GROUP BY c_mktsegment")
def season_group_means(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 4).alias("season")).agg(F.count("*").alias("n"), F.floor(F.avg("c_acctbal")).alias("m"))
    one = F.concat(F.col("season"), F.lit(":"), F.col("m"), F.lit("("), F.col("n"), F.lit(")"))
    return g.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("season", one.alias("t")))), lambda s: s["t"]), ", ").alias("means"))


@Q.add("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY c_mktsegment")
def value_counts(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_nationkey < 10").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@Q.add(
    "matlab_percentile",
    """WITH r AS (SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
a AS (SELECT *, greatest(1, least(n, percent / 100 * n + 0.5)) AS pos FROM r, (SELECT unnest([25.0::DOUBLE, 50, 75, 95]) AS percent))
SELECT c_mktsegment, percent, round(sum(v * (1 - abs(i - pos))), 6) AS value FROM a WHERE abs(i - pos) < 1 GROUP BY c_mktsegment, percent""",
)
def matlab_percentile(spark, sf_dir):
    return statistics.percentiles(read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", [25, 50, 75, 95])


@Q.add("histogram_bins", "SELECT event_type, CASE WHEN value = 100 THEN 19 ELSE floor(value / 5)::INT END AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY 1, 2")
def histogram_bins(spark, sf_dir):
    return statistics.histogram(read(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 5.0, 20)


_NULL = "null_ AS (SELECT l_returnflag AS k, l_discount AS v FROM lineitem), obs AS (SELECT l_returnflag AS k, avg(l_discount) + 0.0413 AS v FROM lineitem GROUP BY 1)"


@Q.add("permutation_p", f"WITH {_NULL} SELECT k, round((1 + count(*) FILTER (WHERE n.v >= o.v)) / (count(*) + 1), 6) AS p FROM null_ n JOIN obs o USING (k) GROUP BY k")
def permutation_p(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("v"))
    return metrics.permutation_p(n, n.groupBy("k").agg((F.avg("v") + 0.0413).alias("v")), ["k"], "v")


@Q.add("selection_frequency", f"WITH {_LONG}, s AS (SELECT fold, feature FROM stat WHERE abs(mean) > 20) SELECT feature, count(*) AS n, round(count(*) / {K}, 6) AS share FROM s GROUP BY feature")
def selection_frequency(spark, sf_dir):
    s = folds.training_statistics(long_features(spark, sf_dir), grouped(spark, sf_dir), "subject").filter(F.abs("mean") > 20)
    return s.groupBy("feature").agg(F.count("*").alias("n"), (F.count("*") / K).alias("share"))


@Q.add("grid_argmax", f"WITH {PRED}, g AS (SELECT lang, c, row_number() OVER (PARTITION BY lang ORDER BY avg(((score > c) = (y = 1))::INT) DESC, c) AS n FROM pred, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.4]) AS c) GROUP BY lang, c) SELECT lang, c FROM g WHERE n = 1")
def grid_argmax(spark, sf_dir):
    from epochlake.operators.epochs import cap

    g = predictions(spark, sf_dir).withColumn("c", F.explode(F.array(*map(F.lit, [0.05, 0.1, 0.2, 0.4]))))
    acc = g.groupBy("lang", "c").agg((-F.avg(((F.col("score") > F.col("c")) == (F.col("y") == 1)).cast("double"))).alias("loss"))
    return cap(acc, ["lang"], ["loss", "c"], 1).select("lang", "c")


@Q.add("nan_inf_audit", "SELECT event_type, round(100 * avg((value > 60)::INT), 6) AS missing, count(*) FILTER (WHERE value < 0) AS infinite, count(*) AS n FROM events GROUP BY event_type")
def nan_inf_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.when(F.col("value") <= 60, F.when(F.col("value") < 0, float("-inf")).otherwise(F.col("value"))).alias("v"))
    return e.groupBy("event_type").agg((100 * F.avg(F.col("v").isNull().cast("double"))).alias("missing"), F.count_if(F.abs("v") == float("inf")).alias("infinite"), F.count("*").alias("n"))


@Q.add("inflation_by_protocol", f"WITH {PRED}, b AS (SELECT lang, doc_id % 2 AS p, 50 * (coalesce(avg(yhat) FILTER (WHERE y = 1), 0) + coalesce(avg(1 - yhat) FILTER (WHERE y = 0), 0)) AS bal FROM pred GROUP BY 1, 2) SELECT a.lang, round(a.bal - b.bal, 6) AS inflation FROM b a JOIN b ON a.lang = b.lang AND a.p = 1 AND b.p = 0")
def inflation_by_protocol(spark, sf_dir):
    m = metrics.confusion(predictions(spark, sf_dir).withColumn("p", F.col("doc_id") % 2), ["lang", "p"])
    wide = m.groupBy("lang").pivot("p", [0, 1]).agg(F.first("bal"))
    return wide.filter("`0` IS NOT NULL AND `1` IS NOT NULL").select("lang", (F.col("1") - F.col("0")).alias("inflation"))


@Q.add("pivot_summary", "PIVOT (SELECT l_shipdate::DATE::VARCHAR[1:4] AS year, l_returnflag, l_quantity FROM lineitem) ON l_returnflag IN ('A', 'N', 'R') USING round(avg(l_quantity), 6) GROUP BY year".replace("l_shipdate::DATE::VARCHAR[1:4]", "year(l_shipdate)::INT"))
def pivot_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_quantity")
    return li.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))


@Q.add("two_level_mean", f"WITH {CH}, c AS (SELECT subject, y, channel, avg(ln(list_var_samp(x) + 2.220446049250313e-16)) AS v FROM ch GROUP BY 1, 2, 3) SELECT subject, y, round(avg(v), 6) AS level FROM c GROUP BY subject, y")
def two_level_mean(spark, sf_dir):
    return channel_levels(spark, sf_dir).groupBy("subject", "y").agg(F.avg("value").alias("level"))


@Q.add("covariance_upper", f"WITH {CH}, l AS (SELECT vec_id, channel, unnest(x) AS v, unnest(range(0, 16)) AS i FROM ch) SELECT a.vec_id, a.channel AS c1, b.channel AS c2, round(covar_samp(a.v, b.v), 6) AS cov FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i = b.i AND a.channel <= b.channel GROUP BY 1, 2, 3")
def covariance_upper(spark, sf_dir):
    long = channel_epochs(spark, sf_dir).select("vec_id", "channel", F.posexplode("x").alias("i", "v"))
    return statistics.covariance(long, ["vec_id"], "channel", "i", "v")


@Q.add(
    "group_mean_psd",
    f"""WITH e AS (SELECT (label % 2)::INT AS y, label * 5 + vec_id % 5 AS subject, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), {WINDOW}, {PSD.format(key="y, subject, vec_id", src="e")},
s AS (SELECT y, subject, k, any_value(hz) AS hz, avg(p) AS p FROM f GROUP BY 1, 2, 3) SELECT y, round(any_value(hz), 6) AS hz, round(10 * log10(avg(p)), 6) AS db FROM s GROUP BY y, k""",
)
def group_mean_psd(spark, sf_dir):
    """Mean Welch density of the subjects of each class, each the mean over its epochs, in decibels."""
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("int").alias("y"), (F.col("label") * 5 + F.col("vec_id") % 5).alias("subject"), F.col("embedding").cast("array<double>").alias("x"))
    p = e.select("y", "subject", F.posexplode(batches.over(lambda x: batches.welch(x, FS, segment=256)[1], None, F.col("x"))).alias("k", "p"))
    return p.groupBy("y", "subject", "k").agg(F.avg("p").alias("p")).groupBy("y", "k").agg((10 * F.log10(F.avg("p"))).alias("db")).select("y", (F.col("k") * FS / 256).alias("hz"), "db")


# --- names, masks and joins


@Q.add("feature_prefix_project", "SELECT p_partkey, string_split(p_name, ' ')[1] AS channel FROM part WHERE string_split(p_name, ' ')[1] IN (SELECT min(string_split(p_name, ' ')[1]) FROM part)")
def feature_prefix_project(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("channel"))
    return p.join(F.broadcast(p.agg(F.min("channel").alias("channel"))), "channel", "left_semi")


@Q.add("feature_regex_mask", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12]') AND NOT starts_with(p_type, 'S')")
def feature_regex_mask(spark, sf_dir):
    return read(spark, sf_dir, "part").filter(F.col("p_brand").rlike("#[12]") & ~F.col("p_type").startswith("S")).select("p_partkey")


@Q.add("channel_rename_map", f"WITH {CH} SELECT vec_id, CASE channel WHEN 'Cz' THEN 'CZ' WHEN 'Oz' THEN 'Iz' ELSE channel END AS channel FROM ch")
def channel_rename_map(spark, sf_dir):
    return joins.renamed(channel_epochs(spark, sf_dir), "channel", {"Cz": "CZ", "Oz": "Iz"}).select("vec_id", "channel")


@Q.add("montage_semi_join", f"WITH {CH} SELECT vec_id, channel FROM ch WHERE lower(channel) IN ('fz', 'cz')")
def montage_semi_join(spark, sf_dir):
    montage = spark.createDataFrame([("FZ",), ("cz",), ("T7",)], "name string").select(F.lower("name").alias("key"))
    return channel_epochs(spark, sf_dir).join(montage, F.lower("channel") == F.col("key"), "left_semi").select("vec_id", "channel")


@Q.add("all_null_columns", f"WITH {R}, f AS (SELECT channel, CASE WHEN channel = 'click' THEN NULL ELSE value END AS v FROM r) SELECT channel, count(v) AS n FROM f GROUP BY channel HAVING count(v) > 0")
def all_null_columns(spark, sf_dir):
    v = recordings(spark, sf_dir).select("channel", F.when(F.col("channel") != "click", F.col("value")).alias("v"))
    return v.groupBy("channel").agg(F.count("v").alias("n")).filter("n > 0")


@Q.add("metadata_join_first", "WITH m AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status, min(o_orderdate) AS first FROM orders GROUP BY o_custkey) SELECT c_custkey, status FROM customer LEFT JOIN m ON o_custkey = c_custkey")
def metadata_join_first(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return joins.first_match(read(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "status")


def _selections(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.filter("p_size % 3 = 0").select("p_partkey"), p.filter("p_size % 5 = 0").select("p_partkey")


@Q.add("mask_intersect", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 INTERSECT SELECT p_partkey FROM part WHERE p_size % 5 = 0")
def mask_intersect(spark, sf_dir):
    a, b = _selections(spark, sf_dir)
    return joins.masks(a, b, "p_partkey", 8)


@Q.add("mask_union_fallback", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 UNION SELECT p_partkey FROM part WHERE p_size % 5 = 0")
def mask_union_fallback(spark, sf_dir):
    a, b = _selections(spark, sf_dir)
    return joins.masks(a, b, "p_partkey", 1_000_000)


@Q.add("mask_except", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 EXCEPT SELECT p_partkey FROM part WHERE p_size % 5 = 0")
def mask_except(spark, sf_dir):
    a, b = _selections(spark, sf_dir)
    return a.exceptAll(b).distinct()


@Q.add("predictions_union_all", f"WITH {PRED} SELECT doc_id, 'a' AS run, y FROM pred UNION ALL SELECT doc_id, 'b', yhat FROM pred")
def predictions_union_all(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("doc_id", F.lit("a").alias("run"), "y").unionByName(p.select("doc_id", F.lit("b").alias("run"), F.col("yhat").alias("y")))


@Q.add("transfer_pairs", "SELECT a.r_name AS train, b.r_name AS test FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey")
def transfer_pairs(spark, sf_dir):
    r = read(spark, sf_dir, "region")
    a, b = r.select(F.col("r_name").alias("train"), F.col("r_regionkey").alias("a")), r.select(F.col("r_name").alias("test"), F.col("r_regionkey").alias("b"))
    return a.join(b, F.col("a") != F.col("b")).select("train", "test")


@Q.add("task_grid", "WITH c AS (SELECT DISTINCT c_mktsegment AS cohort FROM customer), f AS (SELECT DISTINCT event_type AS family FROM events) SELECT cohort, family, r::BIGINT AS repeat, (row_number() OVER (ORDER BY cohort, family, r))::BIGINT AS task FROM c, f, range(1, 4) t(r)")
def task_grid(spark, sf_dir):
    """Every cohort and family that the tables hold, three times each: the numbered tasks of an experiment."""
    cohorts = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cohort")).distinct()
    families = read(spark, sf_dir, "events").select(F.col("event_type").alias("family")).distinct()
    return joins.tasks([cohorts, families], 3)


@Q.add("one_hot_code", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END)::INT AS code, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 100000 ELSE 200000 END AS global_id FROM orders")
def one_hot_code(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array(*[(F.col("o_orderstatus") == s).cast("int") for s in "FOP"]).alias("hot"))
    return o.select("o_orderkey", (F.array_position("hot", 1) - 1).cast("int").alias("code"), "o_custkey").select("o_orderkey", "code", (F.col("o_custkey") + F.col("code") * 100_000).alias("global_id"))


@Q.add("json_property", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k') IS NOT NULL")
def json_property(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k IS NOT NULL")


@Q.add("coerce_cells", "SELECT doc_id, try_cast(trim(string_split(text, ' ')[1]) AS DOUBLE) AS number, nullif(trim(source), '') AS name FROM documents")
def coerce_cells(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = F.trim(F.get(F.split("text", " "), F.lit(0)))
    return d.select("doc_id", first.try_cast("double").alias("number"), F.nullif(F.trim("source"), F.lit("")).alias("name"))


Q.also("coerce_cells_all", "coerce_cells")
