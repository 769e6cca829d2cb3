"""Queries that fit, evaluate and contrast protocols, and match cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.functions import features as ft
from epochlake.functions.arrays import diff, mean
from epochlake.operators import epochs, folds, learn, matching, metrics, permutation, selection
from epochlake.sources.stores import held

from .common import EP, SPARSE, Queries, R, event_epochs, read

Q = Queries()
K = 5
BASE = f"""{R}, {EP}, kept AS (SELECT * FROM ep WHERE subject IN (SELECT subject FROM ep GROUP BY subject HAVING count(*) >= {SPARSE})),
feats AS (SELECT subject, label AS y, epoch, unnest(['logvar', 'mean', 'line']) AS feature,
  unnest([ln(list_var_samp(x) + 2.220446049250313e-16), list_avg(x), list_avg([abs(x[i + 1] - x[i]) for i in range(1, 8)])]) AS value FROM kept),
subs AS (SELECT DISTINCT subject, y FROM feats),
gf AS (SELECT subject, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('1:', subject)), subject) - 1) % {K} + 1 AS fold FROM subs),
rows_ AS (SELECT DISTINCT subject, epoch, y FROM feats),
rf AS (SELECT subject, epoch, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('2:', subject, ':', epoch)), subject, epoch) - 1) % {K} + 1 AS fold FROM rows_),
long AS (SELECT 'P3' AS protocol, f.*, gf.fold FROM feats f JOIN gf USING (subject) UNION ALL SELECT 'P1', f.*, rf.fold FROM feats f JOIN rf USING (subject, epoch))"""
MODEL = """models AS (SELECT k.{k}, k.fold, l.feature, avg(value) AS mean, CASE WHEN stddev_samp(value) < 1e-12 THEN 1 ELSE stddev_samp(value) END AS sd,
  avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0
  FROM (SELECT DISTINCT {k}, fold FROM long) k JOIN long l ON l.{k} = k.{k} AND l.fold <> k.fold GROUP BY k.{k}, k.fold, l.feature),
far AS (SELECT l.{k}, l.subject, l.epoch, l.y, sqrt(sum(pow((value - m1) / sd, 2))) AS d1, sqrt(sum(pow((value - m0) / sd, 2))) AS d0
  FROM long l JOIN models m ON l.{k} = m.{k} AND l.fold = m.fold AND l.feature = m.feature GROUP BY l.{k}, l.subject, l.epoch, l.y),
pred AS (SELECT {k}, subject, epoch, y, (d1 < d0)::INT AS yhat, d0 / (d0 + d1) AS score FROM far),
voted AS (SELECT {k}, subject, any_value(y) AS y, CASE WHEN avg(yhat) = 0.5 THEN avg(score) > 0.5 ELSE avg(yhat) > 0.5 END::INT AS yhat, avg(score) AS score FROM pred GROUP BY {k}, subject),
both_ AS (SELECT {k}, 'epoch' AS level, y, yhat, score FROM pred UNION ALL SELECT {k}, 'subject', y, yhat, score FROM voted),
ranked AS (SELECT *, rank() OVER (PARTITION BY {k}, level ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY {k}, level, round(score, 9)) - 1) / 2 AS rk FROM both_),
res AS (SELECT {k}, level, count(*) AS n, 50 * (avg(yhat) FILTER (WHERE y = 1) + avg(1 - yhat) FILTER (WHERE y = 0)) AS bal,
  (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM ranked GROUP BY {k}, level)"""


def epoch_features(spark, sf_dir):
    """(subject, y, epoch, feature, value) of subjects with enough epochs."""
    e = epochs.drop_sparse(event_epochs(spark, sf_dir), "subject", SPARSE)
    x = F.col("x")
    named = {"logvar": ft.log_variance(x), "mean": mean(x), "line": mean(diff(x), lambda v: F.abs(v))}
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in named.items()])
    # a feature store: every protocol, fold and model reads it
    return held(e.select("subject", F.col("label").alias("y"), "epoch", F.explode(parts).alias("p")).select("subject", "y", "epoch", "p.feature", "p.value"))


def protocols(long):
    """long once for each protocol: P3 folds hold whole subjects, P1 folds hold single rows."""
    subjects = long.select("subject", "y").distinct()
    grouped = folds.grouped_folds(subjects, "subject", "y", K, 1).select("subject", "fold")
    by_row = folds.row_folds(long.select("subject", "epoch", "y").distinct(), ["subject", "epoch"], "y", K, 2).select("subject", "epoch", "fold")
    p3 = long.join(grouped, "subject").withColumn("protocol", F.lit("P3"))
    return p3.unionByName(long.join(by_row, ["subject", "epoch"]).withColumn("protocol", F.lit("P1")))


def scored(predictions, keys: list[str]):
    """(keys, level, n, bal, auc) of epochs and of subjects by vote."""
    voted = metrics.vote(predictions, [*keys, "subject"])
    both = predictions.select(*keys, F.lit("epoch").alias("level"), "y", "yhat", F.round("score", 9).alias("score")).unionByName(voted.select(*keys, F.lit("subject").alias("level"), "y", "yhat", F.round("score", 9).alias("score")))
    c = metrics.confusion(both, [*keys, "level"]).select(*keys, "level", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"), "bal")
    return c.join(metrics.auc(both, [*keys, "level"]), [*keys, "level"])


@Q.add("leakage_contrast", f"WITH {BASE}, {MODEL.format(k='protocol')} SELECT protocol, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res")
def leakage_contrast(spark, sf_dir):
    long = held(protocols(epoch_features(spark, sf_dir)))
    models = learn.centroid_models(long, ["protocol"])
    p = learn.centroid_predictions(long, models, ["protocol", "subject", "epoch", "y"], ["protocol", "fold"])
    return scored(held(p), ["protocol"])


@Q.add("centroid_predictions", f"WITH {BASE}, {MODEL.format(k='protocol')} SELECT subject, epoch, y, yhat, round(score, 6) AS score FROM pred WHERE protocol = 'P3'")
def centroid_predictions(spark, sf_dir):
    long = protocols(epoch_features(spark, sf_dir)).filter("protocol = 'P3'")
    return learn.centroid_predictions(long, learn.centroid_models(long, []), ["subject", "epoch", "y"], ["fold"])


@Q.add(
    "overlap_leakage",
    f"""WITH {R}, {EP}, kept AS (SELECT * FROM ep WHERE subject IN (SELECT subject FROM ep GROUP BY subject HAVING count(*) >= {SPARSE})),
whole AS (SELECT subject, label AS y, flatten(list(x ORDER BY epoch)) AS a FROM kept GROUP BY subject, label),
w AS (SELECT subject, y, a, unnest(range(0, len(a) - 7, 2)) AS st FROM whole), wx AS (SELECT subject, y, st // 2 AS epoch, a[st + 1 : st + 8] AS x FROM w),
feats AS (SELECT subject, y, epoch, unnest(['logvar', 'mean']) AS feature, unnest([ln(list_var_samp(x) + 2.220446049250313e-16), list_avg(x)]) AS value FROM wx),
rf AS (SELECT subject, epoch, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('2:', subject, ':', epoch)), subject, epoch) - 1) % {K} + 1 AS fold FROM (SELECT DISTINCT subject, epoch, y FROM feats)),
long AS (SELECT 'P0' AS protocol, f.*, rf.fold FROM feats f JOIN rf USING (subject, epoch)), {MODEL.format(k='protocol')} SELECT protocol, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res""",
)
def overlap_leakage(spark, sf_dir):
    """P0: row folds over overlapping windows of the same recordings."""
    e = epochs.drop_sparse(event_epochs(spark, sf_dir), "subject", SPARSE)
    w = epochs.sliding(e, ["subject", "label"], 8, 0.75)
    x = F.col("x")
    parts = F.array(F.struct(F.lit("logvar").alias("feature"), ft.log_variance(x).alias("value")), F.struct(F.lit("mean").alias("feature"), mean(x).alias("value")))
    long = w.select("subject", F.col("label").alias("y"), F.col("window").alias("epoch"), F.explode(parts).alias("p")).select("subject", "y", "epoch", "p.feature", "p.value")
    by_row = folds.row_folds(long.select("subject", "epoch", "y").distinct(), ["subject", "epoch"], "y", K, 2).select("subject", "epoch", "fold")
    long = held(long.join(by_row, ["subject", "epoch"]).withColumn("protocol", F.lit("P0")))
    p = learn.centroid_predictions(long, learn.centroid_models(long, ["protocol"]), ["protocol", "subject", "epoch", "y"], ["protocol", "fold"])
    return scored(held(p), ["protocol"])


@Q.add(
    "centroid_transfer",
    f"""WITH {BASE}, coh AS (SELECT *, subject % 3 AS cohort FROM feats),
models AS (SELECT cohort, feature, avg(value) AS mean, stddev_samp(value) AS sd, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0 FROM coh GROUP BY cohort, feature),
far AS (SELECT m.cohort AS train, c.cohort AS test, subject, epoch, y, sqrt(sum(pow((value - m1) / sd, 2))) AS d1, sqrt(sum(pow((value - m0) / sd, 2))) AS d0 FROM coh c JOIN models m ON c.feature = m.feature AND c.cohort <> m.cohort GROUP BY 1, 2, 3, 4, 5)
SELECT train, test, count(*) AS n, round(avg(((d1 < d0)::INT = y)::INT), 6) AS accuracy FROM far GROUP BY train, test""",
)
def centroid_transfer(spark, sf_dir):
    """Scaling and centres of one cohort applied to the others."""
    long = epoch_features(spark, sf_dir).withColumn("cohort", F.col("subject") % 3)
    models = learn.centroid_models(long.withColumn("fold", F.lit(1)), ["cohort"], holdout=False).drop("fold").withColumnRenamed("cohort", "train")
    p = learn.centroid_predictions(long, models, ["train", "cohort", "subject", "epoch", "y"], []).filter("train <> cohort")
    return p.groupBy("train", F.col("cohort").alias("test")).agg(F.count("*").alias("n"), F.avg((F.col("yhat") == F.col("y")).cast("double")).alias("accuracy"))



_PERMUTED = """many AS (SELECT perm, subject, y FROM subs, range(1, 201) t(perm)),
pa AS (SELECT perm, subject, row_number() OVER (PARTITION BY perm ORDER BY md5(concat('5a:', perm, ':', subject)), subject) AS r FROM many),
pb AS (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5(concat('5b:', perm, ':', subject)), subject) AS r FROM many),
lab AS (SELECT perm, subject, y FROM pa JOIN pb USING (perm, r) UNION ALL SELECT 0, subject, y FROM subs)"""


@Q.add(
    "label_permutation",
    f"""WITH {BASE.replace('long AS (', 'lp AS (')}, {_PERMUTED}, own AS (SELECT *, (row_number() OVER (PARTITION BY perm, y ORDER BY md5(concat('1:', perm, ':', subject)), subject) - 1) % {K} + 1 AS fold FROM lab),
long AS (SELECT perm, f.subject, f.epoch, o.y, fold, feature, value FROM feats f JOIN own o USING (subject)), {MODEL.format(k='perm')},
b AS (SELECT perm, round(bal, 9) AS bal FROM res WHERE level = 'subject') SELECT 'centroid' AS model, round((1 + count(*) FILTER (WHERE n.bal >= o.bal)) / (count(*) + 1), 6) AS p FROM b n, b o WHERE n.perm > 0 AND o.perm = 0""",
)
def label_permutation(spark, sf_dir):
    """Share of 200 label permutations of subjects whose balanced accuracy reaches the observed one."""
    found = permutation.permuted_balance(epoch_features(spark, sf_dir), 200, k=K)
    bal = held(found.select(F.lit("centroid").alias("model"), "perm", F.round("bal", 9).alias("bal")))
    return metrics.permutation_p(bal.filter("perm > 0"), bal.filter("perm = 0").drop("perm"), ["model"], "bal")


def _rows(spark, sf_dir):
    long = epoch_features(spark, sf_dir)
    grouped = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", K, 1).select("subject", "fold")
    return learn.wide(long, ["subject", "epoch", "y"], ["logvar", "mean", "line"]).join(grouped, "subject")


@Q.add("forest_grouped_cv")
def forest_grouped_cv(spark, sf_dir):
    p = learn.cross_validated(_rows(spark, sf_dir), "fold", ["subject", "epoch"], "forest", numTrees=100, minInstancesPerNode=5)
    return scored(p.withColumn("model", F.lit("forest")), ["model"])


@Q.add("tree_grouped_cv")
def tree_grouped_cv(spark, sf_dir):
    p = learn.cross_validated(_rows(spark, sf_dir), "fold", ["subject", "epoch"], "tree", minInstancesPerNode=5)
    return scored(p.withColumn("model", F.lit("tree")), ["model"])


@Q.add("kernel_svm_grouped_cv")
def kernel_svm_grouped_cv(spark, sf_dir):
    """A linear machine on Nystroem features of an RBF kernel, fitted with scaling and landmarks on each training part; box constraint 1."""
    fit = {"prepare": lambda training: learn.nystroem(training, ["subject", "epoch"], standardised=True), "regParam": lambda training: 1 / max(1, training.count()), "maxIter": 10}
    p = learn.cross_validated(_rows(spark, sf_dir), "fold", ["subject", "epoch"], "svm", **fit)
    return scored(p.withColumn("model", F.lit("svm")), ["model"])


@Q.add(
    "nearest_neighbours",
    """WITH v AS (SELECT vec_id, (label % 2)::INT AS y, [x::DOUBLE for x in embedding] AS f FROM embeddings),
d AS (SELECT q.vec_id, t.vec_id AS other, t.y, list_sum([pow(q.f[i] - t.f[i], 2) for i in range(1, 65)]) AS d FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS n FROM d)
SELECT vec_id, (avg(y) > 0.5)::INT AS yhat, round(avg(y), 6) AS score FROM r WHERE n <= 5 GROUP BY vec_id""",
)
def nearest_neighbours(spark, sf_dir):
    """A fifth of the vectors against all others, over all components."""
    f = F.transform("embedding", lambda x: x.cast("double"))
    v = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("y"), f.alias("features"))
    return learn.nearest(v.filter("vec_id % 5 <> 0"), v.filter("vec_id % 5 = 0"), ["vec_id"], 5, order=["vec_id"])


Q.also("nearest_neighbours_whole", "nearest_neighbours")


@Q.add(
    "match_nearest_age",
    """WITH RECURSIVE s AS (SELECT c_nationkey % 5 AS cohort, c_custkey AS id, (c_mktsegment = 'BUILDING')::INT AS grp, c_nationkey % 2 AS sex, c_acctbal AS age FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
side AS (SELECT cohort, CASE WHEN count(*) FILTER (WHERE grp = 0) < count(*) FILTER (WHERE grp = 1) THEN 0 ELSE 1 END AS anchor FROM s GROUP BY cohort),
a AS (SELECT s.*, row_number() OVER (PARTITION BY cohort ORDER BY md5(concat('1:', id))) AS n FROM s JOIN side USING (cohort) WHERE grp = anchor),
p AS (SELECT s.* FROM s JOIN side USING (cohort) WHERE grp <> anchor),
m AS (SELECT cohort, 0::BIGINT AS n, NULL::BIGINT AS anchor, NULL::BIGINT AS pick, []::BIGINT[] AS used FROM side
  UNION ALL SELECT m.cohort, m.n + 1, any_value(a.id), arg_min(p.id, (p.sex <> a.sex, abs(p.age - a.age), p.id)), list_append(any_value(m.used), arg_min(p.id, (p.sex <> a.sex, abs(p.age - a.age), p.id)))
  FROM m JOIN a ON a.cohort = m.cohort AND a.n = m.n + 1 JOIN p ON p.cohort = m.cohort WHERE NOT list_contains(m.used, p.id) GROUP BY m.cohort, m.n),
f AS (SELECT anchor AS id, anchor AS pair FROM m WHERE n > 0 UNION ALL SELECT pick, anchor FROM m WHERE n > 0)
SELECT cohort, s.id, grp AS "group", sex, round(age, 6) AS age, pair FROM f JOIN s USING (id)""",
)
def match_nearest_age(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    group = (F.col("c_mktsegment") == "BUILDING").cast("int")
    s = c.select((F.col("c_nationkey") % 5).alias("cohort"), F.col("c_custkey").alias("id"), group.alias("group"), (F.col("c_nationkey") % 2).alias("sex"), F.col("c_acctbal").alias("age"))
    return matching.matched(s, "cohort", ratio=1, smaller_anchors=True)


_FITTED = """SELECT k.{keys}, l.feature, avg(value) AS mean, CASE WHEN stddev_samp(value) < 1e-12 THEN 1 ELSE stddev_samp(value) END AS sd, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0"""
_BY_GAP = "row_number() OVER (PARTITION BY {keys} ORDER BY abs(m1 - m0) / sd DESC, feature) AS rank"


@Q.add(
    "nested_grouped_cv",
    f"""WITH {BASE.replace('long AS (', 'lp AS (')}, l3 AS (SELECT subject, y, epoch, feature, value, fold FROM lp WHERE protocol = 'P3'),
ks AS (SELECT DISTINCT fold AS outer_ FROM gf),
inn AS (SELECT outer_, subject, (row_number() OVER (PARTITION BY outer_, y ORDER BY md5(concat('11:', subject)), subject) - 1) % 3 + 1 AS inner_ FROM subs JOIN gf USING (subject) JOIN ks ON fold <> outer_),
tr AS (SELECT outer_, inner_, subject, epoch, y, feature, value FROM l3 JOIN inn USING (subject)),
mi AS (SELECT *, {_BY_GAP.format(keys='outer_, inner_')} FROM ({_FITTED.format(keys='outer_, k.inner_')} FROM (SELECT DISTINCT outer_, inner_ FROM tr) k JOIN tr l ON l.outer_ = k.outer_ AND l.inner_ <> k.inner_ GROUP BY k.outer_, k.inner_, l.feature)),
fi AS (SELECT outer_, k, subject, epoch, y, sqrt(sum(pow((value - m1) / sd, 2))) AS d1, sqrt(sum(pow((value - m0) / sd, 2))) AS d0 FROM tr JOIN mi USING (outer_, inner_, feature), range(1, 4) t(k) WHERE rank <= k GROUP BY outer_, k, subject, epoch, y),
bi AS (SELECT outer_, k, 50 * (avg((d1 < d0)::INT) FILTER (WHERE y = 1) + avg(1 - (d1 < d0)::INT) FILTER (WHERE y = 0)) AS bal FROM fi GROUP BY outer_, k),
best AS (SELECT outer_, arg_min(k, (-round(bal, 9), k)) AS k FROM bi GROUP BY outer_),
long AS (SELECT 'P3' AS protocol, * FROM l3),
{MODEL.format(k='protocol').replace("far AS (", f"picked AS (SELECT * FROM (SELECT *, {_BY_GAP.format(keys='fold')} FROM models) JOIN best ON outer_ = fold WHERE rank <= k)," + chr(10) + "far AS (", 1).replace("JOIN models m ON l", "JOIN picked m ON l", 1)} SELECT protocol, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res""",
)
def nested_grouped_cv(spark, sf_dir):
    """Features ranked and counted inside each training part, subjects kept whole."""
    long = held(protocols(epoch_features(spark, sf_dir)).filter("protocol = 'P3'").drop("protocol"))
    p = selection.nested_predictions(long, [1, 2, 3]).withColumn("protocol", F.lit("P3"))
    return scored(held(p), ["protocol"])


@Q.add(
    "specificity_scores",
    f"""WITH {BASE.replace('long AS (', 'lp AS (')}, kf AS (SELECT subject, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('1:', subject)), subject) - 1) % {K} + 1 AS fold FROM subs WHERE subject % 4 <> 3),
known AS (SELECT f.*, fold FROM feats f JOIN kf USING (subject)),
models AS (SELECT k.fold, feature, avg(value) AS mean, stddev_samp(value) AS sd, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0 FROM (SELECT DISTINCT fold FROM known) k JOIN known l ON l.fold <> k.fold GROUP BY k.fold, feature),
far AS (SELECT fold, subject, epoch, sqrt(sum(pow((value - m1) / sd, 2))) AS d1, sqrt(sum(pow((value - m0) / sd, 2))) AS d0 FROM feats JOIN models USING (feature) WHERE subject % 4 = 3 GROUP BY fold, subject, epoch)
SELECT subject, round(avg(d0 / (d0 + d1)), 6) AS score, (avg(d0 / (d0 + d1)) > 0.5)::INT AS label FROM far GROUP BY subject""",
)
def specificity_scores(spark, sf_dir):
    """Every fold's model scores a third population that no fold has seen; the mean score decides."""
    long = epoch_features(spark, sf_dir).withColumn("third", F.col("subject") % 4 == 3)
    known = long.filter(~F.col("third"))
    dealt = folds.grouped_folds(known.select("subject", "y").distinct(), "subject", "y", K, 1).select("subject", "fold")
    models = learn.centroid_models(known.join(dealt, "subject"), [])
    p = learn.centroid_predictions(long.filter("third").drop("fold"), models, ["fold", "subject", "epoch"], [])
    mean_score = F.avg("score")
    return p.groupBy("subject").agg(mean_score.alias("score"), (mean_score > 0.5).cast("int").alias("label"))


@Q.add("wrapper_selection")
def wrapper_selection(spark, sf_dir):
    """Both wrapper searches over a sample of epochs, then what both select, or either if both select fewer than two."""
    import numpy as np

    rows = learn.wide(epoch_features(spark, sf_dir), ["subject", "epoch", "y"], ["logvar", "mean", "line"])
    few = rows.orderBy(folds.shuffled(9, "subject", "epoch"), "subject", "epoch").limit(1500).toPandas()
    x = np.array(few["features"].tolist(), float)
    loss = selection.wrapper_fitness(spark, (x - x.mean(0)) / x.std(0), few["y"].to_numpy(), few["subject"].to_numpy())
    a, b = selection.grey_wolves(loss, 3, 20, 40), selection.aquila(loss, 3, 20, 40)
    both = a & b if (a & b).sum() >= 2 else a | b
    return spark.createDataFrame([(n, bool(p), bool(q), bool(r)) for n, p, q, r in zip(("logvar", "mean", "line"), a, b, both, strict=True)], "feature string, wolves boolean, eagles boolean, selected boolean")
