"""Queries of evaluation protocols: where features are selected, subsets, transfer, group experiments, inner grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.functions import features as ft
from epochlake.functions.arrays import mean
from epochlake.operators import epochs, folds, joins, learn, metrics, protocols, selection, statistics
from epochlake.sources.stores import held

from .common import SPARSE, Queries, event_epochs, read
from .learn_queries import BASE, MODEL, K, epoch_features, scored
from .learn_queries import protocols as by_protocol
from .stat_queries import T_TAIL

Q = Queries()
TOP = 2
FEATURES = ["line", "logvar", "mean"]

# --- what selection may see

_T = "coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 0), 0)"
_MOM = "count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0, var_samp(value) FILTER (WHERE y = 1) AS v1, var_samp(value) FILTER (WHERE y = 0) AS v0"
#: features by subject-level |t| of the rows outside each fold; of all rows where `sees`
CHOSEN = f"""sm AS (SELECT k.{{k}}, k.fold, l.subject, any_value(l.y) AS y, l.feature, avg(value) AS value FROM (SELECT DISTINCT {{k}}, fold FROM long) k JOIN long l ON l.{{k}} = k.{{k}} AND ({{sees}} OR l.fold <> k.fold) GROUP BY k.{{k}}, k.fold, l.subject, l.feature),
mo AS (SELECT {{k}}, fold, feature, {_MOM} FROM sm GROUP BY {{k}}, fold, feature),
chosen AS (SELECT {{k}}, fold, feature FROM (SELECT *, row_number() OVER (PARTITION BY {{k}}, fold ORDER BY round(abs({_T}), 9) DESC, feature) AS n FROM mo) WHERE n <= {TOP})"""


def picked(model: str, k: str) -> str:
    """The centroid statement with its models held to the chosen features."""
    return model.replace("far AS (", f"picked AS (SELECT m.* FROM models m SEMI JOIN chosen c ON c.{k} = m.{k} AND c.fold = m.fold AND c.feature = m.feature),\nfar AS (", 1).replace("JOIN models m ON l", "JOIN picked m ON l", 1)


_LONG3 = BASE.replace("UNION ALL SELECT 'P1', f.*, rf.fold FROM feats f JOIN rf USING (subject, epoch))", "UNION ALL SELECT p, f.*, rf.fold FROM feats f JOIN rf USING (subject, epoch), (SELECT unnest(['P1', 'P2']) AS p))")


@Q.add("selection_protocols", f"WITH {_LONG3}, {CHOSEN.format(k='protocol', sees=chr(39).join(['l.protocol = ', 'P1', '']))}, {picked(MODEL.format(k='protocol'), 'protocol')} SELECT protocol, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res")
def selection_protocols(spark, sf_dir):
    """P1: row folds, features selected on all rows; P2: row folds, selected in the fold; P3: folds of whole subjects, selected in the fold."""
    long = held(by_protocol(epoch_features(spark, sf_dir)))
    rows, whole = long.filter("protocol = 'P1'"), long.filter("protocol = 'P3'")
    inside = rows.withColumn("protocol", F.lit("P2")).unionByName(whole)
    p = protocols.selected_predictions(rows, ["protocol"], TOP, holdout=False).unionByName(protocols.selected_predictions(inside, ["protocol"], TOP))
    return scored(held(p), ["protocol"])


# --- feature subsets

SUBSETS = {"all": FEATURES, "logvar": ["logvar"], "not_logvar": ["line", "mean"], "mean": ["mean"], "not_mean": ["line", "logvar"], "line": ["line"], "not_line": ["logvar", "mean"], "first": ["line", "logvar"]}
_SUBSETS = "subsets AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}')" for s, fs in SUBSETS.items() for f in fs) + ") t(subset, feature))"
_ABLATION = f"WITH {BASE.replace('long AS (', 'lp AS (')}, {_SUBSETS}, long AS (SELECT s.subset, l.subject, l.y, l.epoch, l.feature, l.value, l.fold FROM lp l JOIN subsets s USING (feature) WHERE l.protocol = 'P3'), {MODEL.format(k='subset')} SELECT subset, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res"


def _subsets(spark, sf_dir, names):
    long = held(by_protocol(epoch_features(spark, sf_dir)).filter("protocol = 'P3'").drop("protocol"))
    table = spark.createDataFrame([(s, f) for s in names for f in SUBSETS[s]], "subset string, feature string")
    many = protocols.over_subsets(long, table)
    p = learn.centroid_predictions(many, learn.centroid_models(many, ["subset"]), ["subset", "subject", "epoch", "y"], ["subset", "fold"])
    return scored(held(p), ["subset"])


@Q.add("feature_ablation", _ABLATION)
def feature_ablation(spark, sf_dir):
    """Eight subsets of the features under the same folds, in one job."""
    return _subsets(spark, sf_dir, list(SUBSETS))


@Q.add("logvar_baseline", f"SELECT * FROM ({_ABLATION}) WHERE subset IN ('all', 'logvar')")
def logvar_baseline(spark, sf_dir):
    """The log-variance alone beside all features, with the same learner."""
    return _subsets(spark, sf_dir, ["all", "logvar"])


@Q.add("forest_ablation")
def forest_ablation(spark, sf_dir):
    """The subsets under the same folds with a forest each. A missing value is the training median."""
    rows, _ = _wide(spark, sf_dir)
    p = protocols.over_columns(rows, FEATURES, {n: SUBSETS[n] for n in ("all", "logvar", "not_logvar", "first")}, lambda part: learn.cross_validated(part, "fold", ["subject", "epoch"], "forest", numTrees=100, minInstancesPerNode=5))
    return scored(held(p), ["subset"])


@Q.add("forest_nested_cv")
def forest_nested_cv(spark, sf_dir):
    """Features ranked in each training part, and how many of them a forest takes chosen by inner folds of its subjects."""
    rows, long = _wide(spark, sf_dir)
    p = protocols.nested_forest(rows, long, FEATURES, [1, 2, 3], numTrees=100, minInstancesPerNode=5)
    return scored(held(p.withColumn("protocol", F.lit("P3"))), ["protocol"])


def _wide(spark, sf_dir):
    """(subject, epoch, y, fold, features) and the long rows with folds of whole subjects."""
    long = held(by_protocol(epoch_features(spark, sf_dir)).filter("protocol = 'P3'").drop("protocol"))
    return held(learn.wide(long, ["subject", "epoch", "y", "fold"], FEATURES)), long


# --- transfer

_COH = f"{BASE}, coh AS (SELECT *, subject % 3 AS cohort FROM feats)"
_TRANSFER = f"""WITH {_COH},
sm AS (SELECT cohort, subject, any_value(y) AS y, feature, avg(value) AS value FROM coh GROUP BY cohort, subject, feature),
mo AS (SELECT cohort, feature, {_MOM} FROM sm GROUP BY cohort, feature),
chosen AS (SELECT cohort, feature FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round(abs({_T}), 9) DESC, feature) AS n FROM mo) WHERE n <= {{top}}),
models AS (SELECT cohort, feature, avg(value) AS mean, stddev_samp(value) AS sd, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m0 FROM coh SEMI JOIN chosen USING (cohort, feature) GROUP BY cohort, feature),
own AS (SELECT cohort, feature, avg(value) AS mean, stddev_samp(value) AS sd FROM coh GROUP BY cohort, feature),
far AS (SELECT m.cohort AS train, c.cohort AS test, subject, epoch, y, sqrt(sum(pow((value - s.mean) / s.sd - (m1 - m.mean) / m.sd, 2))) AS d1, sqrt(sum(pow((value - s.mean) / s.sd - (m0 - m.mean) / m.sd, 2))) AS d0
  FROM coh c JOIN models m ON c.feature = m.feature AND c.cohort <> m.cohort JOIN own s ON s.feature = c.feature AND s.cohort = {{scale}}.cohort GROUP BY 1, 2, 3, 4, 5),
pred AS (SELECT train, test, subject, epoch, y, (d1 < d0)::INT AS yhat, d0 / (d0 + d1) AS score FROM far),
voted AS (SELECT train, test, subject, any_value(y) AS y, CASE WHEN avg(yhat) = 0.5 THEN avg(score) > 0.5 ELSE avg(yhat) > 0.5 END::INT AS yhat, avg(score) AS score FROM pred GROUP BY train, test, subject),
both_ AS (SELECT train, test, 'epoch' AS level, y, yhat, score FROM pred UNION ALL SELECT train, test, 'subject', y, yhat, score FROM voted),
ranked AS (SELECT *, rank() OVER (PARTITION BY train, test, level ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY train, test, level, round(score, 9)) - 1) / 2 AS rk FROM both_),
res AS (SELECT train, test, level, count(*) AS n, 50 * (avg(yhat) FILTER (WHERE y = 1) + avg(1 - yhat) FILTER (WHERE y = 0)) AS bal,
  (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM ranked GROUP BY train, test, level)"""
_RES = " SELECT train, test, level, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res"


def _transfer(spark, sf_dir, **how):
    long = epoch_features(spark, sf_dir).withColumn("cohort", F.col("subject") % 3)
    return scored(held(protocols.transfer(long, "cohort", **how)), ["train", "test"])


@Q.add("transfer_with_selection", _TRANSFER.format(top=TOP, scale="m") + _RES)
def transfer_with_selection(spark, sf_dir):
    """Statistics, selection and centres of one cohort applied to the others."""
    return _transfer(spark, sf_dir, k=TOP)


@Q.add("transfer_own_scaling", _TRANSFER.format(top=99, scale="c") + _RES)
def transfer_own_scaling(spark, sf_dir):
    """Centres of one cohort, in units of deviations, applied to others that are scaled by themselves."""
    return _transfer(spark, sf_dir, own_scale=True)


@Q.add("transfer_matrix", f"PIVOT ({_TRANSFER.format(top=TOP, scale='m')} SELECT train, test, bal FROM res WHERE level = 'subject') ON test IN (0, 1, 2) USING round(any_value(bal), 6) GROUP BY train")
def transfer_matrix(spark, sf_dir):
    """Balanced accuracy by training and test cohort; a cohort isn't tested on itself."""
    m = _transfer(spark, sf_dir, k=TOP).filter("level = 'subject'")
    return m.groupBy("train").pivot("test", [0, 1, 2]).agg(F.first("bal"))


# --- selection chain

_CHAIN = f"""v AS (SELECT label * 5 + vec_id % 5 AS subject, (label % 2)::INT AS y, printf('c%02d', i) AS feature, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) r(i)),
fo AS (SELECT subject, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('1:', subject)), subject) - 1) % {K} + 1 AS fold FROM (SELECT DISTINCT subject, y FROM v)),
tr AS (SELECT v.* FROM v JOIN fo USING (subject) WHERE fold <> 1),
a AS (SELECT feature AS k FROM (SELECT feature, row_number() OVER (ORDER BY abs(avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0)) / stddev_samp(value) DESC, feature) AS n FROM tr GROUP BY feature) WHERE n <= 20),
sm AS (SELECT subject, any_value(y) AS y, feature, avg(value) AS value FROM tr GROUP BY subject, feature),
mo AS (SELECT feature, {_MOM} FROM sm GROUP BY feature),
w AS (SELECT feature AS k, {_T} AS t, (n1 + n0 - 2)::DOUBLE AS df FROM mo),
b AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY round(abs(t), 9) DESC, k) AS n FROM w) WHERE n <= 20),
both_ AS (SELECT * FROM a INTERSECT SELECT * FROM b), cand AS (SELECT * FROM both_ UNION SELECT u.* FROM (SELECT * FROM a UNION SELECT * FROM b) u WHERE (SELECT count(*) FROM both_) < 8),
p AS (SELECT k, {T_TAIL} AS p FROM w SEMI JOIN cand USING (k), range(0, 2001) x(i) GROUP BY k)"""


@Q.add(
    "selection_chain",
    f"""WITH {_CHAIN}, r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rank, count(*) OVER () AS m FROM p),
l AS (SELECT coalesce(max(rank) FILTER (WHERE p <= rank / m * 0.05), 0) AS last FROM r) SELECT k FROM r, l WHERE rank <= last OR last < 5""",
)
def selection_chain(spark, sf_dir):
    """Of a training part, the features that both the distance of class centres and the t of subjects' means rank high (either, if both hold fewer
    than eight), then those whose t passes a test for many (all of them, if fewer than five do)."""
    e = read(spark, sf_dir, "embeddings").select((F.col("label") * 5 + F.col("vec_id") % 5).alias("subject"), (F.col("label") % 2).cast("int").alias("y"), F.posexplode("embedding").alias("i", "value"))
    long = held(e.select("subject", "y", F.format_string("c%02d", "i").alias("feature"), F.col("value").cast("double").alias("value")))
    outside = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", K, 1).filter("fold <> 1").select("subject")
    training = held(long.join(outside, "subject", "left_semi"))
    centres = selection.ranked(learn.centroid_models(training.withColumn("fold", F.lit(1)), [], holdout=False), ["fold"]).filter("rank <= 20").select(F.col("feature").alias("k"))
    means = training.groupBy("subject", "y", "feature").agg(F.avg("value").alias("value"))
    tests = held(statistics.pooled_t(statistics.two_groups(means, ["feature"], "y", "value")).withColumnRenamed("feature", "k"))
    by_t = tests.orderBy(F.round(F.abs("t"), 9).desc(), "k").limit(20).select("k")
    candidates = joins.masks(centres, by_t, "k", 8)
    tested = statistics.with_p(tests.withColumn("df", (F.col("n1") + F.col("n0") - 2).cast("double"))).select("k", "p")
    return selection.kept_by_test(tested.join(candidates, "k", "left_semi"), "k", 5).select("k")


# --- groups of one subject table

# The two sides of each experiment; `C` groups are the healthy ones here
_SIDES = {"A": (["BUILDING"], ["MACHINERY"]), "B1": (["BUILDING"], ["AUTOMOBILE"]), "B2": (["BUILDING"], ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]), "C": (["BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], ["MACHINERY"]), "C2": (["AUTOMOBILE"], ["MACHINERY"])}
PAIRS = [(e, g, y) for e, (one, zero) in _SIDES.items() for y, gs in ((1, one), (0, zero)) for g in gs]
_GROUPS = f"""WITH pairs AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{g}', {y})" for e, g, y in PAIRS)}) t(experiment, grp, y)),
o AS (SELECT o_custkey, avg(o_totalprice) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey AS subject, c_mktsegment AS grp, c_acctbal AS balance, coalesce(price, 0) AS price, coalesce(n, 0) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey),
d AS (SELECT experiment, subject, y, (row_number() OVER (PARTITION BY experiment, y ORDER BY md5(concat('6:', experiment, ':', subject)), subject) - 1) % {K} + 1 AS fold, balance, price, n FROM s JOIN pairs USING (grp)),
long AS (SELECT experiment, subject, 0 AS epoch, y, fold, unnest(['balance', 'price', 'orders']) AS feature, unnest([balance, price, n]) AS value FROM d)"""


@Q.add("group_experiments", f"{_GROUPS}, {MODEL.format(k='experiment')} SELECT experiment, n, round(bal, 6) AS bal, round(auc, 6) AS auc FROM res WHERE level = 'subject'")
def group_experiments(spark, sf_dir):
    """Pairs of groups of one subject table, each with folds and models of its own, all in one job."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"))
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("balance")).join(o, "subject", "left").fillna(0, ["price", "n"])
    d = protocols.experiments(s, spark.createDataFrame(PAIRS, "experiment string, group string, y int"), K, 6)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("value")) for f, c in (("balance", "balance"), ("price", "price"), ("orders", "n"))])
    long = held(d.select("experiment", "subject", F.lit(0).alias("epoch"), "y", "fold", F.explode(parts).alias("p")).select("experiment", "subject", "epoch", "y", "fold", "p.*"))
    p = learn.centroid_predictions(long, learn.centroid_models(long, ["experiment"]), ["experiment", "subject", "epoch", "y"], ["experiment", "fold"])
    return scored(held(p), ["experiment"]).filter("level = 'subject'").drop("level")


# --- inner grids


def _folded(spark, sf_dir):
    """Wide rows of each outer fold, scaled by what is outside it: (subject, epoch, y, fold, outer, features)."""
    long = epoch_features(spark, sf_dir)
    dealt = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", K, 1).select("subject", "fold")
    z = folds.scaled(long, folds.training_statistics(long, dealt, "subject")).withColumnRenamed("fold", "outer").drop("value").withColumnRenamed("z", "value")
    return learn.wide(z, ["outer", "subject", "epoch", "y"], FEATURES).join(dealt, "subject")


KNN_GRID = [5, 15, 35]
_INV = "1 / greatest(sqrt(d), 1e-12)"
_SHARE = "(sum({w} * y / nc) FILTER (WHERE n <= k) / sum({w} / nc) FILTER (WHERE n <= k))".format(w=_INV)


@Q.add(
    "knn_grid_cv",
    f"""WITH {BASE}, st AS (SELECT k.fold AS outer_, feature, avg(value) AS mean, CASE WHEN coalesce(stddev_samp(value), 0) < 1e-12 THEN 1 ELSE stddev_samp(value) END AS sd FROM (SELECT DISTINCT fold FROM gf) k JOIN long l ON l.protocol = 'P3' AND l.fold <> k.fold GROUP BY k.fold, feature),
z AS (SELECT outer_, subject, epoch, y, fold, list((value - mean) / sd ORDER BY feature) AS f FROM long JOIN st USING (feature) WHERE protocol = 'P3' GROUP BY outer_, subject, epoch, y, fold),
inn AS (SELECT outer_, subject, (row_number() OVER (PARTITION BY outer_, y ORDER BY md5(concat('11:', subject)), subject) - 1) % 3 + 1 AS inner_ FROM (SELECT DISTINCT k.fold AS outer_, subject, y FROM gf JOIN subs USING (subject) JOIN (SELECT DISTINCT fold FROM gf) k ON k.fold <> gf.fold)),
tr AS (SELECT z.*, inner_ FROM z JOIN inn USING (outer_, subject)),
c1 AS (SELECT k.outer_, k.inner_, t.y, count(*) AS nc FROM (SELECT DISTINCT outer_, inner_ FROM tr) k JOIN tr t ON t.outer_ = k.outer_ AND t.inner_ <> k.inner_ GROUP BY k.outer_, k.inner_, t.y),
c2 AS (SELECT outer_, y, count(*) AS nc FROM z WHERE fold <> outer_ GROUP BY outer_, y),
d1 AS (SELECT a.outer_, a.inner_, a.subject, a.epoch, a.y AS truth, b.y, list_sum([pow(a.f[i] - b.f[i], 2) for i in range(1, 4)]) AS d, row_number() OVER (PARTITION BY a.outer_, a.subject, a.epoch ORDER BY list_sum([pow(a.f[i] - b.f[i], 2) for i in range(1, 4)]), b.subject, b.epoch) AS n FROM tr a JOIN tr b ON a.outer_ = b.outer_ AND a.inner_ <> b.inner_),
v1 AS (SELECT outer_, k, subject, epoch, truth, ({_SHARE} > 0.5)::INT AS yhat FROM d1 JOIN c1 USING (outer_, inner_, y), (SELECT unnest({KNN_GRID}) AS k) WHERE n <= 35 GROUP BY outer_, k, subject, epoch, truth),
bal AS (SELECT outer_, k, 50 * (avg(yhat) FILTER (WHERE truth = 1) + avg(1 - yhat) FILTER (WHERE truth = 0)) AS bal FROM v1 GROUP BY outer_, k),
best AS (SELECT outer_, arg_min(k, (-round(bal, 9), k)) AS k FROM bal GROUP BY outer_),
d2 AS (SELECT a.outer_, a.subject, a.epoch, a.y AS truth, b.y, list_sum([pow(a.f[i] - b.f[i], 2) for i in range(1, 4)]) AS d, row_number() OVER (PARTITION BY a.outer_, a.subject, a.epoch ORDER BY list_sum([pow(a.f[i] - b.f[i], 2) for i in range(1, 4)]), b.subject, b.epoch) AS n FROM z a JOIN z b ON a.outer_ = b.outer_ AND a.fold = a.outer_ AND b.fold <> b.outer_)
SELECT subject, epoch, truth AS y, outer_::INT AS fold, k::INT AS k, ({_SHARE} > 0.5)::INT AS yhat, round({_SHARE}, 6) AS score FROM d2 JOIN best USING (outer_) JOIN c2 USING (outer_, y) WHERE n <= 35 GROUP BY outer_, k, subject, epoch, truth""",
)
def knn_grid_cv(spark, sf_dir):
    """Nearest neighbours by inverse distance, both classes with the same prior, with a k for each fold that inner folds of whole subjects choose."""
    return protocols.knn_grid(held(_folded(spark, sf_dir)), KNN_GRID)


def _grid(spark, sf_dir, name, parameter, grid, **params):
    p = protocols.grid_cross_validated(_folded(spark, sf_dir), ["subject", "epoch"], name, parameter, grid, **params)
    return scored(held(p.withColumn("model", F.lit(name))), ["model"])


@Q.add("tree_grid_cv")
def tree_grid_cv(spark, sf_dir):
    return _grid(spark, sf_dir, "tree", "minInstancesPerNode", [1, 5, 20])


@Q.add("forest_grid_cv")
def forest_grid_cv(spark, sf_dir):
    return _grid(spark, sf_dir, "forest", "minInstancesPerNode", [1, 5], numTrees=100)


#: A box constraint C over n rows is a regularisation of 1 / (C n).
BOX = {"prepare": lambda training: learn.nystroem(training, ["subject", "epoch"]), "setting": lambda c, n: 1 / (c * max(1, n)), "maxIter": 10}


@Q.add("kernel_svm_grid_cv")
def kernel_svm_grid_cv(spark, sf_dir):
    """A linear machine on Nystroem features of an RBF kernel, whose landmarks and scale are the training part's; the box constraint is chosen."""
    return _grid(spark, sf_dir, "svm", "regParam", [0.1, 1.0, 10.0], **BOX)


# --- stores and subjects on the way there


@Q.add("validation_split_epochs", "WITH r AS (SELECT user_id AS subject, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), ep AS (SELECT subject, pos // 8 AS epoch FROM r GROUP BY subject, pos // 8 HAVING count(*) = 8), n AS (SELECT *, row_number() OVER (ORDER BY md5(concat('4:', subject, ':', epoch)), subject, epoch) AS n, count(*) OVER () AS c FROM ep) SELECT subject, epoch, n <= greatest(2, floor(0.15 * c + 0.5)) AS validation FROM n")
def validation_split_epochs(spark, sf_dir):
    """The row form of the validation split: epochs of one subject fall on both sides."""
    return folds.validation_split(event_epochs(spark, sf_dir), ["subject", "epoch"], 0.15, 4)


_HELD = f"WITH {BASE}"


@Q.add(
    "robust_scale_in_fold",
    f"{_HELD}, tr AS (SELECT k.fold, l.* EXCLUDE (fold) FROM (SELECT DISTINCT fold FROM gf) k JOIN long l ON l.protocol = 'P3' AND l.fold <> k.fold), me AS (SELECT fold, feature, median(value) AS med FROM tr GROUP BY fold, feature), sc AS (SELECT t.fold, t.feature, median(abs(value - med)) * 1.4826 AS mad FROM tr t JOIN me m ON t.fold = m.fold AND t.feature = m.feature GROUP BY t.fold, t.feature) SELECT l.subject, l.epoch, s.fold, l.feature, round(coalesce(value / greatest(mad, 2.220446049250313e-16), 0), 6) AS z FROM feats l JOIN sc s USING (feature)",
)
def robust_scale_in_fold(spark, sf_dir):
    """Values over the scaled median deviation of the training part of each fold; missing ones are 0."""
    long = epoch_features(spark, sf_dir)
    dealt = folds.grouped_folds(long.select("subject", "y").distinct(), "subject", "y", K, 1).select("subject", "fold")
    return folds.robust_scaled(long, dealt, "subject").select("subject", "epoch", "fold", "feature", "z")


@Q.add("report_order", f"WITH {BASE}, {MODEL.format(k='protocol')} SELECT (row_number() OVER (ORDER BY round(auc, 6) DESC, protocol, level))::INT AS place, protocol, level, round(auc, 6) AS auc FROM res")
def report_order(spark, sf_dir):
    """Results of protocols by falling area under the curve. A row for each protocol and level."""
    from pyspark.sql import Window

    from .learn_queries import leakage_contrast

    res = leakage_contrast(spark, sf_dir).select("protocol", "level", F.round("auc", 6).alias("auc"))
    return res.withColumn("place", F.row_number().over(Window.orderBy(F.col("auc").desc(), "protocol", "level"))).select("place", "protocol", "level", "auc")


@Q.add("point_lookup", f"WITH {BASE}, {MODEL.format(k='protocol')} SELECT protocol, level, round(auc, 6) AS auc FROM res WHERE protocol = 'P3' AND level = 'subject'")
def point_lookup(spark, sf_dir):
    """One cell of a table of results by its keys."""
    from .learn_queries import leakage_contrast

    return joins.lookup(leakage_contrast(spark, sf_dir), {"protocol": "P3", "level": "subject"}, ["protocol", "level", "auc"], ["protocol"])
