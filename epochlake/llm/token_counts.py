"""Token counts from an exact histogram of encoded lengths.

Every document is encoded whole, in Arrow batches, and only its length is kept.
Documents are aggregated by length, in part before the shuffle, and suffix sums over
the lengths say how many documents, with how many ids, have at least each length.
From these follow the total, every quantile and, for every context limit L, the ids
that are left when each document is cut at L:

    total - (ids of documents longer than L) + L * (documents longer than L)

Between two lengths that occur this is linear in L, so a row for each length that
occurs answers for all limits.

Nothing here grows with one key: what is left of a hot key after the aggregation is a
row for each length. The suffix sums run inside slices of 4,096 lengths; a row for each
slice is all that the window over slices sees.

Edge cases: a null or empty text has length 0 and counts as a document; texts of any
length are encoded whole; repeated rows count each time; null is a key of its own; an
empty table has an empty histogram, the totals 0 and no quantile (null). Other columns
are ignored by the sums; `lengths` keeps them and replaces one called n_tokens. Keys
named like a column of the result raise an error.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Lengths of one slice.
SLICE_LENGTHS = 4096
RESULT = ["n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "truncated_tokens", "share_up_to", "total_docs", "total_tokens"]


class Encoder:
    """Lengths under a byte-level BPE vocabulary, of which `ranks` is the merge table and `full` the whole tokenizer."""

    def __init__(self, ranks: str, full: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.full = full

    @functools.cached_property
    def patient(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.full)
        found.encode_special_tokens = True
        return found

    def length(self, text: str | None) -> int:
        if not text:
            return 0
        try:
            return len(self.fast.encode_to_numpy(text, disallowed_special=()))
        except ValueError:
            # its pattern gives up on runs of some hundred thousand spaces; the other library has the same vocabulary
            return len(self.patient.encode(text, add_special_tokens=False).ids)


@functools.cache
def encoder(ranks: str, full: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(ranks, full, pattern)


def lengths(docs: DataFrame, ranks: str, full: str, pattern: str, column: str = "text", extra_ids: int = 0) -> DataFrame:
    """docs with n_tokens, the encoded length of a column and extra_ids for what is put around each document."""
    kept = [f for f in docs.schema.fields if f.name != "n_tokens"]

    def run(batches):
        coder = encoder(ranks, full, pattern)
        for b in batches:
            # one text at a time: a batch of long texts is many times its size as ids
            n = pa.array((coder.length(t.as_py()) + extra_ids for t in b.column(b.schema.get_field_index(column))), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], n], names=[*[f.name for f in kept], "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType())]))


def histogram(measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_tokens, n_docs) from rows with n_tokens, written once so that nothing is encoded twice."""
    if clash := set(by) & set(RESULT):
        raise ValueError(f"keys named like columns of the result: {sorted(clash)}")
    return cut(measured.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs")))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key and length that occurs:

    docs_at_least, tokens_at_least: documents of that length or more, and their ids;
    truncated_tokens: all ids if that length is the context limit; share_up_to: share
    of documents of that length or less; total_docs, total_tokens: of the key.
    """
    sliced = hist.withColumn("_slice", F.floor(F.col("n_tokens") / SLICE_LENGTHS)).withColumn("_ids", F.col("n_tokens") * F.col("n_docs"))
    per_slice = sliced.groupBy(*by, "_slice").agg(F.sum("n_docs").alias("_d"), F.sum("_ids").alias("_t"))
    later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    after = per_slice.select(
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(by)],
        F.col("_slice").alias("_at"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_ids_after"),
        F.sum("_d").over(every).alias("total_docs"),
        F.sum("_t").over(every).alias("total_tokens"),
    )
    same = functools.reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.col("_slice") == F.col("_at"))
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        sliced.withColumn("_d", F.sum("n_docs").over(inside))
        .withColumn("_t", F.sum("_ids").over(inside))
        .join(after, same)
        .withColumn("docs_at_least", F.col("_d") + F.col("_docs_after"))
        .withColumn("tokens_at_least", F.col("_t") + F.col("_ids_after"))
    )
    longer_docs = F.col("docs_at_least") - F.col("n_docs")
    longer_ids = F.col("tokens_at_least") - F.col("_ids")
    return (
        sums.withColumn("truncated_tokens", F.col("total_tokens") - longer_ids + longer_docs * F.col("n_tokens"))
        .withColumn("share_up_to", 1 - longer_docs / F.col("total_docs"))
        .select(*[f"`{k}`" for k in by], *RESULT)
    )


def at_limits(sums: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, context_limit, total_tokens, truncated_docs, truncated_tokens) for any limits of 0 or more, in one pass over suffix sums.

    truncated_docs counts the documents longer than the limit. A key that has no
    documents has no row; without keys there is always a row for each limit.
    """
    next_ = lambda limit: F.min(F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    found = sums.groupBy(*by).agg(
        F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.array(*[F.struct(F.lit(int(limit)).cast("long").alias("limit"), next_(limit).alias("next")) for limit in limits]).alias("_limits"),
    )
    one = found.select(*[f"`{k}`" for k in by], "total_tokens", F.explode("_limits").alias("_l"))
    docs, ids = (F.coalesce(F.col(f"_l.next.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    return one.select(
        *[f"`{k}`" for k in by],
        F.col("_l.limit").alias("context_limit"),
        "total_tokens",
        docs.alias("truncated_docs"),
        (F.col("total_tokens") - ids + docs * F.col("_l.limit")).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, share, n_tokens): the smallest length that at least that share of documents don't exceed; exact."""
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    reached = lambda q: F.min(F.when(up_to >= F.ceil(F.lit(float(q)) * F.col("total_docs")), F.col("n_tokens")))
    found = sums.groupBy(*by).agg(F.array(*[F.struct(F.lit(float(q)).alias("share"), reached(q).alias("n_tokens")) for q in shares]).alias("_q"))
    return found.select(*[f"`{k}`" for k in by], F.explode("_q").alias("_q")).select(*[f"`{k}`" for k in by], "_q.share", "_q.n_tokens")


def token_counts(docs: DataFrame, ranks: str, full: str, pattern: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The suffix sums of the histogram of a table of documents."""
    return suffix_sums(histogram(lengths(docs.select(*[f"`{k}`" for k in by], "text"), ranks, full, pattern), by), by)
