"""Join-shaped operators: positions, first matches, masks, grids and name lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def numbered(df: DataFrame, order: list[str], slices: int = 64) -> DataFrame:
    """df with `row`, 1 .. n in the order; rows that tie on the first column stay in one slice."""
    first = order[0]
    timed = dict(df.dtypes)[first] in ("timestamp", "timestamp_ntz")
    number = F.unix_micros(F.col(first).cast("timestamp")) if timed else F.col(first)
    sliced = ranks.by_value(df, number, slices).withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return ranks.before(sliced, ["_all"], order, {"row": "_one"}).withColumn("row", F.col("row") + 1).drop("_one", "_all")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join with the first row of right for each key, in the order; keys of right may repeat."""
    rest = [c for c in right.columns if c not in on]
    best = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return left.join(best, on, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in rest])


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """column with some of its values renamed; the others stay."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def masks(a: DataFrame, b: DataFrame, on: str, least: int) -> DataFrame:
    """What both selections hold; what either holds, if both hold fewer than `least`."""
    both = a.select(on).intersect(b.select(on))
    few = both.agg((F.count("*") < least).alias("_few"))
    either = a.select(on).union(b.select(on)).distinct().join(F.broadcast(few)).filter("_few").drop("_few")
    return both.union(either).distinct()


def grid(spark, **axes) -> DataFrame:
    """Every combination of the values of the axes: the task table of an experiment. Its axes are short lists."""
    parts = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def tasks(axes: list[DataFrame], repeats: int) -> DataFrame:
    """(columns of the axes, repeat from 1 on, task): every combination of rows of the axes, numbered in their order.

    An axis is a list of names (cohorts, families), and the number of tasks is what an experiment runs one by one.
    """
    from pyspark.sql import Window

    every = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
    names = every.columns
    many = every.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)).cast("array<bigint>")))
    return many.withColumn("task", F.row_number().over(Window.orderBy(*names, "repeat")).cast("long"))


def lookup(df: DataFrame, keys: dict, columns: list[str], order: list[str]) -> DataFrame:
    """The columns of the first row, in the order, whose keys have the values; no row if none has."""
    for k, v in keys.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df.orderBy(*order).limit(1).select(*columns)


def routed(df: DataFrame, column: str, routes: dict, otherwise: tuple) -> DataFrame:
    """df with store and label: the route of the value of the column, or the one for all other values. A write partitioned by store makes the stores."""
    store, label = F.lit(otherwise[0]), F.lit(otherwise[1])
    for value, (s, n) in routes.items():
        store, label = F.when(F.col(column) == value, s).otherwise(store), F.when(F.col(column) == value, n).otherwise(label)
    return df.withColumn("store", store).withColumn("label", label)


def in_parts(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """df with row, 1 .. n over all parts: the place inside a part, by the order, after the rows of the parts before it.

    Parts are numbered; an order inside a part is cut into slices of its first column.
    """
    sliced = ranks.by_value(df, F.col(order[0]), 64).withColumn("_one", F.lit(1))
    placed = ranks.before(sliced, [part], order, {"_at": "_one"})
    sizes = df.groupBy(part).agg(F.count("*").alias("_n"))
    # a row for each part is all that this window sees
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return placed.join(offsets, part).withColumn("row", F.col("_before") + F.col("_at") + 1).select(*df.columns, "row")
