"""Running sums and ranks over long orders, so that no task holds more than a slice of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_value(df: DataFrame, number, slices: int = 64) -> DataFrame:
    """df with _s, a slice number that rises with `number`, by approximate quantiles; equal numbers share a slice."""
    edges = df.select(number.cast("double").alias("v")).agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < number.cast("double"))) if edges else F.lit(0)
    return df.withColumn("_s", at)


def before(sliced: DataFrame, keys: list[str], order: list, amounts: dict[str, str]) -> DataFrame:
    """sliced with, for each new column: amount, the sum of that column over the rows before, inside the keys.

    `order` sorts rows inside a slice of a key; a row for each key and slice is all that the totals' window sees.
    """
    if not keys:
        one = before(sliced.withColumn("_all", F.lit(0)), ["_all"], order, amounts)
        return one.drop("_all")
    totals = sliced.groupBy(*keys, "_s").agg(*[F.sum(a).alias(f"_t_{n}") for n, a in amounts.items()])
    ahead = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_s", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_a_{n}") for n in amounts])
    inside = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_i_{n}") for n, a in amounts.items()])
    found = own.join(totals, [*keys, "_s"])
    return found.select(*sliced.columns, *[(F.col(f"_a_{n}") + F.col(f"_i_{n}")).alias(n) for n in amounts]).drop("_s")


def places(df: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """df with place, 0 .. n - 1 inside the keys by (text, order), where text is a hexadecimal hash: its head is the slice."""
    return before(df.withColumn("_s", F.substring(text, 1, 3)).withColumn("_one", F.lit(1)), keys, [text, *order], {"place": "_one"}).drop("_one")
