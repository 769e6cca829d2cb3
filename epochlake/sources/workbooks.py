"""Sheets of .xlsx workbooks: a small function unpacks the archive, Spark's XML functions read the sheet and its shared strings.

Rows and cells of the sheet are rows of a table, texts are looked up by a join with the shared strings, and names
come from the first row that has a cell. A workbook is a bounded file; many of them are read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stores import held

TEXT = "STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>"
SHEET = f"STRUCT<sheetData: STRUCT<row: ARRAY<STRUCT<_r: BIGINT, c: ARRAY<STRUCT<_r: STRING, _t: STRING, v: STRING, `is`: {TEXT}>>>>>>"
STRINGS = f"STRUCT<si: ARRAY<{TEXT}>>"


def unpacked(content: bytes, sheet: int) -> tuple[str | None, str | None, str | None]:
    """(sheet, shared strings, error) of a workbook; sheets count from 1 in the order of their files."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
            if len(names) < sheet:
                return None, None, f"no sheet {sheet}"
            strings = z.read("xl/sharedStrings.xml").decode() if "xl/sharedStrings.xml" in z.namelist() else "<sst/>"
            return z.read(names[sheet - 1]).decode(), strings, None
    except (zipfile.BadZipFile, UnicodeDecodeError, RuntimeError, KeyError) as e:
        return None, None, str(e) or type(e).__name__


def _text(item):
    """The text of a string item, or of its runs."""
    return F.coalesce(item["t"], F.concat_ws("", F.transform(item["r"], lambda r: F.coalesce(r["t"], F.lit("")))))


def read_cells(spark: SparkSession, path: str, sheet: int = 1) -> tuple[DataFrame, DataFrame]:
    """((path, row, column, value), (path, error)): the cells of a sheet of each workbook at path, values as texts; unreadable workbooks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, *unpacked(c, sheet)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "strings", "error"])

    parts = files.mapInPandas(run, "path string, sheet string, strings string, error string")
    fine = parts.filter("error IS NULL")
    keep = {"ignoreSurroundingSpaces": "false", "rowTag": "root"}
    rows = fine.select("path", F.explode(F.from_xml("sheet", SHEET, keep)["sheetData"]["row"]).alias("r"))
    cells = rows.select("path", F.col("r._r").alias("row"), F.explode("r.c").alias("c"))
    # the letters of a cell's reference, as a number
    letters = F.regexp_extract("c._r", "^[A-Z]+", 0)
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))
    placed = cells.select("path", "row", column.alias("column"), F.col("c._t").alias("kind"), F.col("c.v").alias("v"), _text(F.col("c.is")).alias("inline"))
    strings = fine.select("path", F.posexplode(F.from_xml("strings", STRINGS, keep)["si"]).alias("place", "item")).select("path", "place", _text(F.col("item")).alias("text"))
    shared = F.when(F.col("kind") == "s", F.col("v").try_cast("int"))
    met = placed.withColumn("place", shared).join(strings, ["path", "place"], "left")
    value = F.when(F.col("kind") == "s", F.col("text")).when(F.col("kind") == "inlineStr", F.col("inline")).when(F.col("kind") == "e", F.lit(None)).otherwise(F.col("v"))
    return met.select("path", "row", "column", value.alias("value")).filter("value IS NOT NULL"), parts.filter("error IS NOT NULL").select("path", "error")


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str], numbers: tuple[str, ...] = (), sheet: int = 1) -> DataFrame:
    """(path, row, the columns): new name by name in the first row, looked up without case and blanks; `numbers` (new names) as doubles, null where they aren't.

    The rows of tables.read_participants() from an export of the sheet: absent cells are empty texts, rows without any cell are left out. A workbook
    that can't be read, or lacks one of the columns, is an error that names it; of equal names the first counts.
    """
    cells, errors = read_cells(spark, path, sheet)
    cells = held(cells)
    bad = errors.first()
    if bad:
        raise ValueError(f"{bad['path']}: {bad['error']}")
    first = F.min("row").over(Window.partitionBy("path"))
    every = cells.withColumn("_first", first)
    # a row for each workbook and column
    heads = every.filter("row = _first").groupBy("path", F.lower(F.trim("value")).alias("name")).agg(F.min("column").alias("column"))
    wanted = spark.createDataFrame([(new, name.strip().lower()) for new, name in columns.items()], "new string, name string")
    places = heads.join(F.broadcast(wanted), "name")
    short = places.groupBy("path").agg(F.collect_set("new").alias("has")).filter(F.size("has") < len(columns)).first()
    if short or places.isEmpty() and not cells.isEmpty():
        absent = [name for new, name in columns.items() if not short or new not in short["has"]]
        raise ValueError(f"no column {', '.join(absent)}")
    body = every.filter("row > _first").select("path", "row", "column", "value")
    rows = body.select("path", "row").distinct()
    named = body.join(places.select("path", "column", "new"), ["path", "column"]).groupBy("path", "row").pivot("new", list(columns)).agg(F.first("value"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.join(named, ["path", "row"], "left").select("path", "row", *[(text(c).try_cast("double") if c in numbers else text(c)).alias(c) for c in columns])
