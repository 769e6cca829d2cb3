"""Tables about subjects: sheets exported as CSV, tables of text, and the recordings that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as texts; fields that a short line lacks are empty texts, not null."""
    raw = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def read_participants(spark: SparkSession, path: str, columns: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """The columns, new name by name in the sheet, looked up without case and blanks; `numbers` (new names) as doubles, null where they aren't.

    A sheet without one of the columns is an error that names it.
    """
    raw = read_texts(spark, path)
    known = {c.strip().lower(): c for c in reversed(raw.columns)}
    absent = [c for c in columns.values() if c.strip().lower() not in known]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    value = lambda new, c: F.trim(F.col(f"`{known[c.strip().lower()]}`"))
    return raw.select(*[(value(n, c).try_cast("double") if n in numbers else value(n, c)).alias(n) for n, c in columns.items()])


def with_recordings(subjects: DataFrame, key: str, files: DataFrame, path: str = "path") -> DataFrame:
    """subjects with the first of the files, by name, that lie in a folder named like the key; subjects without one are left out."""
    # every folder of a path may be a subject's
    folders = files.select(F.col(path).alias("_p"), F.explode(F.array_distinct(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1))).alias("_k"))
    first = folders.filter(F.col("_k") != "").groupBy("_k").agg(F.min("_p").alias("recording"))
    return subjects.join(first, subjects[key].cast("string") == F.col("_k")).drop("_k")
