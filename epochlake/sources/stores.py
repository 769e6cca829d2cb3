"""Epoch, feature and result stores as partitioned Parquet, and tables held between steps of a job."""

from __future__ import annotations

import logging
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; on one machine (tests) without one, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='epochlake-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in that folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def whole(spark: SparkSession, path: str) -> bool:
    """Has a store been written to its end?"""
    fs, there = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(there)


def save(df: DataFrame, path: str, by: list[str], skip_existing: bool = True) -> None:
    """Writes a store partitioned by its leading keys; a whole one that is there already stays, as a finished stage isn't run again. One that was left half-written is written anew."""
    keep = skip_existing and whole(df.sparkSession, path)
    df.write.partitionBy(*by).mode("ignore" if keep else "overwrite").parquet(path)


def finished(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """(keys): the tasks that a resumable store's manifest names. keys: column and type."""
    manifest, schema = f"{path}.done", ", ".join(f"{k} {t}" for k, t in keys.items())
    fs, there = _files(spark, manifest)
    return spark.read.schema(schema).parquet(manifest).distinct() if fs.exists(there) else spark.createDataFrame([], schema)


def resume(spark: SparkSession, path: str, work: DataFrame, build, log: logging.Logger | None = None) -> int:
    """Builds what is missing of a store partitioned by the columns of `work`, a list of tasks; returns how many tasks that were.

    build(key as a dict) gives a task's rows without the keys. Each task overwrites its partition alone, and is named in the manifest
    (`path`.done) when that is written: a run that ends in between does that task again, and no other. What a task wrote before it was
    broken off is gone, also if it has no rows now.
    """
    kinds = dict(work.dtypes)
    keys = list(kinds)
    left = work.distinct().join(finished(spark, path, kinds), keys, "left_anti").orderBy(*keys).collect()
    for r in left:
        key = r.asDict()
        part = build(key).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in key.items()], "*")
        # the partition as Spark would name it, removed first: an empty result wouldn't overwrite it
        names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        fs, there = _files(spark, "/".join([path, *(f"{names.escapePathName(k)}={names.escapePathName(str(v))}" for k, v in key.items())]))
        fs.delete(there, True)
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        spark.createDataFrame([tuple(r)], work.schema).coalesce(1).write.mode("append").parquet(f"{path}.done")
        if log:
            log.info("finished %s", key)
    return len(left)


def load(spark: SparkSession, path: str, exclude: dict[str, list[str]] | None = None, **equal: str) -> DataFrame | None:
    """Rows of a store by partition; None if there is no store. Filters on partition columns prune files."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    for k, v in equal.items():
        df = df.filter(df[k] == v)
    for k, vs in (exclude or {}).items():
        df = df.filter(~df[k].isin(vs))
    return df


def run_log(path: str, name: str = "epochlake") -> logging.Logger:
    """A log of a run on the console and in a file of the driver, each line with its time stamp."""
    log = logging.getLogger(f"{name}:{path}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        log.propagate = False
        for h in (logging.StreamHandler(sys.stdout), logging.FileHandler(path, encoding="utf-8")):
            h.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%Y-%m-%d %H:%M:%S"))
            log.addHandler(h)
    return log


def counted_errors(read: DataFrame, log: logging.Logger | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The rows of a reader without an error, and how many files were unreadable by error (a row each); the log names the counts."""
    rows = read.filter("error IS NOT NULL").groupBy("error").count().orderBy("error").limit(1000).collect()
    counts = {r["error"]: r["count"] for r in rows}
    for e, n in counts.items():
        if log:
            log.info("skipped %d: %s", n, e)
    return read.filter("error IS NULL").drop("error"), counts
