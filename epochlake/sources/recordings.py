"""Readers of recordings and subject tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bdf

CHANNEL_ROWS = "path string, channel string, fs double, samples array<double>, error string"


def decode_bdf(content: bytes, wanted: list[str]) -> list[tuple[str, float, np.ndarray]]:
    """(channel, fs, samples in physical units) of the wanted signals of a 24-bit BDF file, labels matched without case.

    A record count below 0 is taken from the file's length; a truncated last record is dropped.
    """
    header = bdf.Header(content, len(content))
    return header.decoded(content[header.length :], wanted, header.records)


def read_bdf(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """A row for each file and wanted channel; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, c, fs, x.tolist(), None) for c, fs, x in decode_bdf(content, wanted)]
                except ValueError as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "channel", "fs", "samples", "error"])

    return files.mapInPandas(run, CHANNEL_ROWS)


def read_channel_csv(spark: SparkSession, path: str, wanted: list[str], time: str = "timestamps") -> tuple[DataFrame, DataFrame]:
    """(samples, rates) of CSV recordings, each by its own header.

    samples: (path, time, wanted); units after channel names are cut off, names are matched without case, and rows with
    a value that isn't finite are dropped. rates: (path, fs, error), fs estimated as (n - 1) / (last - first time); a file
    without one of the columns has no samples and names it in error.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("line", F.monotonically_increasing_id())
    # a file's first line is the earliest of its first block; combined before the shuffle, a row a file
    files = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "line").alias("head"))
    names = F.transform(F.split(F.trim("head"), ","), lambda c: F.lower(F.trim(F.regexp_replace(c, r"\(.*\)$", ""))))
    places = files.select("path", F.array(*[F.array_position(names, c.lower()).cast("int") for c in [time, *wanted]]).alias("at"))
    absent = [F.when(F.get("at", F.lit(i)) == 0, F.lit(f"no column {c}")) for i, c in enumerate([time, *wanted])]
    checked = places.withColumn("error", F.coalesce(*absent))
    found = lines.select("path", F.split("value", ",").alias("v")).join(checked.filter("error IS NULL").select("path", "at"), "path")
    cells = [F.trim(F.get("v", F.get("at", F.lit(i)) - 1)).try_cast("double").alias(c) for i, c in enumerate([time, *wanted])]
    fine = found.select("path", *cells).filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('infinity')" for c in [time, *wanted]))
    rates = fine.groupBy("path").agg(F.try_divide(F.count("*") - 1, F.max(time) - F.min(time)).alias("fs"))
    return fine, checked.select("path", "error").join(rates, "path", "left").select("path", "fs", "error")


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """(user, diagnosed, age, sex 1 = male) of a JSON array of people."""
    schema = "user string, diagnosed string, age double, gender int"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select("user", F.lower(F.trim("diagnosed")).alias("diagnosed"), "age", F.col("gender").alias("sex"))


def read_subject_table(spark: SparkSession, path: str, least_fields: int = 28, n_channels: int = 26) -> DataFrame:
    """(id, group, levels): lines with enough comma-separated fields; the channels are the last ones and all finite."""
    fields = spark.read.text(path).select(F.split("value", ",").alias("f")).filter(F.size("f") >= least_fields)
    levels = F.transform(F.slice("f", -n_channels, n_channels), lambda v: F.trim(v).try_cast("double"))
    rows = fields.select(F.trim(F.get("f", F.lit(0))).alias("id"), F.trim(F.get("f", F.lit(1))).alias("group"), levels.alias("levels"))
    return rows.filter(F.forall("levels", lambda v: v.isNotNull() & ~F.isnan(v)))


def file_number(path):
    """The number in a file name like d12.csv, to order parts by."""
    return F.regexp_extract(path, r"(\d+)\D*$", 1).cast("long")


def metric_rows(df: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """keys and values as a report writes them: numbers with `digits` decimals, commas in texts as semicolons, null as nothing."""
    number = lambda c: F.coalesce(F.format_string(f"%.{digits}f", F.col(c)), F.lit(""))
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append(F.when(F.col(c).isNotNull(), number(c)).otherwise("").alias(c))
        else:
            out.append(F.translate(F.col(c).cast("string"), ",", ";").alias(c) if c in keys or t == "string" else F.col(c))
    return df.select(*out)


def write_metrics(df: DataFrame, path: str, keys: list[str], digits: int = 3) -> None:
    """A CSV with a header of metric_rows(); a mean and its deviation stand beside each other as the columns do."""
    metric_rows(df, keys, digits).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


# The columns of a row of experiment results.
EXPERIMENT = ["experiment", "n_pos", "n_neg", "BAL", "BAL_sd", "SEN", "SEN_sd", "SPE", "SPE_sd", "AUC", "AUC_sd", "MCC", "MCC_sd", "perm_p"]


def experiment_rows(repeats: DataFrame, counts: DataFrame, p: DataFrame | None = None) -> DataFrame:
    """A row of EXPERIMENT for each experiment: repeats (experiment, bal, sen, spe, auc, mcc) as mean and deviation over the
    repeats, counts (experiment, n_pos, n_neg), and the permutation p where there is one (experiment, perm_p)."""
    from epochlake.operators.metrics import mean_sd

    names = ["bal", "sen", "spe", "auc", "mcc"]
    m = mean_sd(repeats, ["experiment"], names).select("experiment", *[F.col(f"{c}{x}").alias(f"{c.upper()}{x}") for c in names for x in ("", "_sd")])
    rows = counts.join(m, "experiment")
    rows = rows.join(p, "experiment", "left") if p is not None else rows.withColumn("perm_p", F.lit(None).cast("double"))
    return rows.select(*EXPERIMENT)
