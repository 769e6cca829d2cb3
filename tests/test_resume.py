"""Stores that resume by partition."""

import pytest

from epochlake.sources import stores


class Killed(Exception):
    pass


def test_a_killed_run_is_resumed_where_it_stopped(spark, tmp_path):
    path = f"{tmp_path}/store"
    work = spark.createDataFrame([(f, d) for f in ("td", "bp/x=1") for d in (1, 2)], "family string, dataset int")
    built = []

    def build(key, fail=None, rows=2):
        if key == fail:
            raise Killed
        built.append((key["family"], key["dataset"]))
        return spark.range(rows).select("id")

    order = sorted((r["family"], r["dataset"]) for r in work.collect())
    third = dict(zip(("family", "dataset"), order[2], strict=True))
    with pytest.raises(Killed):
        stores.resume(spark, path, work, lambda k: build(k, third))
    assert built == order[:2]
    # what the broken task had written when it was killed
    spark.range(9).selectExpr("id", f"'{third['family']}' AS family", f"{third['dataset']} AS dataset").write.mode("append").partitionBy("family", "dataset").parquet(path)
    built.clear()
    assert stores.resume(spark, path, work, lambda k: build(k, rows=0 if k == third else 3)) == 2 and built == order[2:]
    rows = spark.read.schema("id long, family string, dataset int").parquet(path).groupBy("family", "dataset").count().collect()
    assert {(r["family"], r["dataset"]): r["count"] for r in rows} == {order[0]: 2, order[1]: 2, order[3]: 3}
    assert stores.resume(spark, path, work, build) == 0
    assert stores.resume(spark, path, work.unionByName(spark.createDataFrame([("new", 1)], work.schema)), build) == 1


def test_a_half_written_store_is_written_anew(spark, tmp_path):
    path = f"{tmp_path}/half"
    df = spark.range(4).selectExpr("id", "id % 2 AS k")
    df.filter("k = 0").write.partitionBy("k").parquet(path)
    (tmp_path / "half" / "_SUCCESS").unlink()
    stores.save(df, path, ["k"])
    assert spark.read.parquet(path).count() == 4
    stores.save(df.limit(1), path, ["k"])
    assert spark.read.parquet(path).count() == 4
