"""Mixing sources to target weights by weighted fair queueing.

Every document is a packet of `size` words in the queue of its source. Inside a
source the documents are shuffled (by an md5 of seed and doc_id, so reruns agree)
and each copy gets a virtual finish time: the words of its source up to and with
that copy, divided by the source's weight. All copies of all sources are then
range-sorted by finish time, and the sort is truncated where the running total of
words reaches the budget. A source whose copies have all been served leaves the
queue, so its unused share goes to the others by weight; this is what the closed
form of `targets` says.

A source may hold a third of all rows, so no window runs over a whole source: the
running sums are taken inside slices of the shuffled order, and slices get the
sum of what stands before them from an aggregated table.

Nulls, ties and repeated rows: a null text has size 0; null is a source of its
own that comes last; a null doc_id is shuffled like an empty string. Rows that
share source and doc_id are one place in the shuffled order: they are taken
together or not at all. Very long texts are counted whole and taken whole. An empty
table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, n_words

#: Rows of one slice of a source's shuffled order, about.
SLICE_ROWS = 4096


def shuffle_key(doc_id, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Adds weight and target to (source, source_size).

    The sources whose bound, repeats * source_size, is the smallest for their weight
    are bounded first: in the order of bound / weight they are a prefix, and the first
    source whose bound / weight is above the level of the rest ends it. One row for
    each source is all that these windows see.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("bound_ratio", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (
        sources.withColumn("source_index", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("source_index") % len(weights) + 1).cast("int")))
        .withColumn("bound", F.col("source_size") * repeats)
        .withColumn("bound_ratio", F.col("bound") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("bounded_before", F.coalesce(F.sum("bound").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("bounded_before")) / F.col("weight_left"))
    )
    unbounded = F.when(F.col("bound_ratio") > F.col("level"), F.struct("bound_ratio", "source_index", "level"))
    level = F.min(unbounded).over(every)["level"]
    return ranked.withColumn(
        "target",
        F.when(level.isNull() | (F.col("bound_ratio") <= level), F.col("bound").cast("double")).otherwise(level * F.col("weight")),
    ).select("source", "source_size", "source_rows", "source_index", "weight", "target", "budget")


def finish_times(sized: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """(source_index, place, doc_id, copy, size, finish) of every copy; sized has (doc_id, source, size, place)."""
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / SLICE_ROWS))
    queued = (
        sized.groupBy("source", "place", "doc_id")
        .agg(F.sum("size").alias("size"))
        .join(bounded(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("slice", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2**32 * slices))
    )
    by_slice = queued.groupBy("source_index", "slice").agg(F.sum("size").alias("words"))
    ahead = by_slice.withColumn(
        "ahead", F.coalesce(F.sum("words").over(Window.partitionBy("source_index").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("source_index", "slice", "ahead")
    inside = Window.partitionBy("source_index", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        queued.withColumn("inside", F.sum("size").over(inside))
        .join(ahead, ["source_index", "slice"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("ahead") + F.col("inside")) / F.col("weight"))
        .select("source_index", "place", "doc_id", "copy", "size", "finish", "budget")
    )


def served(copies: DataFrame) -> DataFrame:
    """The copies before the point of the global order where the budget is spent."""
    order = ["finish", "source_index", "copy", "place", "doc_id"]
    sorted_ = cut(copies.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    # one row for each partition of the range sort
    parts = sorted_.groupBy("part").agg(F.sum("size").alias("words"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("before", F.sum("words").over(running) - F.col("words")).select("part", F.col("words").alias("part_words"), "before")
    placed = sorted_.join(parts, "part")
    whole = placed.filter(F.col("before") + F.col("part_words") <= F.col("budget"))
    crossing = placed.filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("part_words") > F.col("budget")))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = crossing.withColumn("total", F.col("before") + inside).filter(F.col("total") <= F.col("budget")).drop("total")
    return whole.unionByName(last)


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sized, sources): the documents with their sizes, and for each source its target and,
    for each copy, the last place of its shuffled order that the mix takes (`last`, an array)."""
    sized = cut(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("place", shuffle_key(F.col("doc_id"), seed))
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = cut(targets(by_source, weights, share, repeats))
    lasts = [F.max(F.when(F.col("copy") == c, F.struct("place", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id")))).alias(f"last_{c}") for c in range(repeats)]
    per_source = served(finish_times(sized, sources, repeats)).groupBy("source_index").agg(*lasts)
    return sized, cut(sources.join(per_source, "source_index", "left"))


def times_taken(sources: DataFrame, repeats: int):
    """How many copies of a row, with its place and doc_id, the mix takes."""
    here = F.struct(F.col("place"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"))
    return sum((F.coalesce((here <= F.col(f"last_{c}")).cast("int"), F.lit(0)) for c in range(repeats)), F.lit(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): the words that the mix takes of each document."""
    sized, sources = plan(docs, weights, share, repeats, seed)
    lasts = [f"last_{c}" for c in range(repeats)]
    found = sized.join(bounded(sources.select(F.col("source").alias("s"), "source_size", "target", *lasts)), F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * times_taken(sources, repeats)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of the mix with all columns of docs, a row for each copy taken. Texts are not shuffled:
    what was decided comes back as one row for each source."""
    _, sources = plan(docs, weights, share, repeats, seed)
    lasts = [f"last_{c}" for c in range(repeats)]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", "doc_id", shuffle_key(F.col("doc_id"), seed).alias("place"))
    found = held.join(bounded(sources.select(F.col("source").alias("s"), *lasts)), F.col("source").eqNullSafe(F.col("s")))
    n = times_taken(sources, repeats)
    return found.withColumn("n", n).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
