"""Queries and operators do the whole job: tests for findings of the reviews."""

import os

import pytest
from pyspark.sql import functions as F

from epochlake.operators import learn, selection, statistics
from epochlake.plans import registry
from epochlake.streaming import windows

DATA = os.environ.get("WHOLE_SF_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def explained(df):
    return df._jdf.queryExecution().toString()


@tables
@pytest.mark.parametrize(("name", "table"), [("coerce_cells", "documents"), ("bh_select", "part")])
def test_queries_read_whole_tables(spark, name, table):
    whole = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert registry.QUERIES[name](spark, DATA).count() == whole > 500


def test_benjamini_hochberg_ranks_in_slices(spark):
    p = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000 / 20000.0 + F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.0)).alias("p"))
    out = statistics.benjamini_hochberg(p, "k")
    got = {r["k"]: (r["rank"], r["selected"]) for r in out.collect()}
    order = sorted((r["p"], r["k"]) for r in p.collect())
    last = max((i for i, (v, _) in enumerate(order, 1) if v <= i / 3000 * 0.05), default=0)
    assert last and got == {k: (i, i <= last) for i, (_, k) in enumerate(order, 1)}
    # no window over all the rows
    assert not any("Window [row_number" in line for line in explained(out).splitlines())


def test_nearest_has_no_row_cap_and_keeps_ties_in_order(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (6500, 4)).astype(float)  # many ties
    y = rng.integers(0, 2, 6500)
    q = rng.integers(0, 6, (60, 4)).astype(float)
    train = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, y int, features array<double>")
    test = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(q)], "id int, features array<double>")
    for weighted in (False, True):
        got = {r["id"]: r["score"] for r in learn.nearest(train, test, ["id"], 7, weighted=weighted, order=["i"], block_rows=1000).collect()}
        assert len(got) == 60
        for i, a in enumerate(q):
            d = ((x - a) ** 2).sum(1)
            best = np.argsort(d, kind="stable")[:7]
            w = 1 / np.maximum(np.sqrt(d[best]), 1e-12) if weighted else np.ones(7)
            assert got[i] == pytest.approx((w * y[best]).sum() / w.sum())
    unordered = {r["id"]: r["score"] for r in learn.nearest(train, test, ["id"], 7, block_rows=1000).collect()}
    assert unordered == {r["id"]: r["score"] for r in learn.nearest(train, test, ["id"], 7, order=["i"]).collect()}


class Seen(Exception):
    pass


@tables
def test_registered_sizes_are_the_reference_s(spark, monkeypatch):
    seen = {}

    def stop(name):
        def f(*args, **named):
            seen[name] = (args, named)
            raise Seen

        return f

    def learned(rows, fold, keep, name, **named):
        seen[name] = (rows.select(fold).distinct().count(), named)
        raise Seen

    monkeypatch.setattr(learn, "cross_validated", learned)
    monkeypatch.setattr(learn, "permuted_labels", stop("permuted"))
    monkeypatch.setattr(selection, "wrapper_fitness", lambda spark, x, y, group: seen.update(rows=len(x)))
    monkeypatch.setattr(selection, "grey_wolves", lambda loss, *a: seen.update(wolves=a))
    monkeypatch.setattr(selection, "aquila", stop("aquila"))
    for name in ("forest_grouped_cv", "tree_grouped_cv", "kernel_svm_grouped_cv", "label_permutation", "wrapper_selection"):
        with pytest.raises(Seen):
            registry.QUERIES[name](spark, DATA)
    assert [seen[n][0] for n in ("forest", "tree", "svm")] == [5, 5, 5] and seen["forest"][1]["numTrees"] == 100
    assert seen["permuted"][0][1] == 200
    assert seen["wolves"] == (3, 20, 40) and seen["aquila"][0][1:] == (3, 20, 40)
    assert 300 < seen["rows"] <= 1500


def test_wrapper_losses_do_not_depend_on_what_was_asked_before(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y, group = rng.integers(0, 2, 90), np.arange(90) % 9
    x = np.c_[y + rng.normal(0, 0.1, 90), rng.normal(0, 1, 90)]
    loss = selection.wrapper_fitness(spark, x, y, group)
    masks = np.array([[True, False], [False, True], [True, False], [False, False]])
    first = loss(masks)
    assert first[0] == first[2] < first[1] and np.array_equal(loss(masks[::-1]), first[::-1])


@tables
def test_stream_sessions_are_all_there(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    want = sorted(map(tuple, windows.sessions(events, ["user_id"], "30 minutes").select("user_id", F.unix_micros("start"), F.unix_micros("end"), "n").collect()))
    got = sorted(map(tuple, registry.QUERIES["stream_sessions"](spark, DATA).collect()))
    assert got == want and sum(r[3] for r in got) == events.count()


def test_counted_epochs_sort_over_all_frames(spark, tmp_path):
    spark.range(400).select((F.col("id") % 2).alias("user_id"), (400 - F.col("id")).alias("event_id"), (400 - F.col("id")).cast("double").alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, value double").parquet(f"{tmp_path}/in")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        windows.counted_epochs(stream, "user_id", "value", 8).writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {(r["user_id"], r["epoch"]): r["mean"] for r in spark.table("counted").collect()}
    want = {}
    for u in (0, 1):
        values = sorted(float(400 - i) for i in range(400) if i % 2 == u)
        want |= {(u, e): sum(values[8 * e : 8 * e + 8]) / 8 for e in range(25)}
    assert got == want
