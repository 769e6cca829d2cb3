"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only where the session names none and runs on one machine (tests), a local folder is taken.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='epochlake-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder so that lost executors don't force a recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df for a join: broadcast if it is counted to have at most `most` rows, which must be narrow, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Folders that this session has made in the shared folder, for sweep().
_scratch: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one."""
    _scratch.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _scratch[-1]


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Removes the folders that scratch() has named; for when no result that reads them is needed any more."""
    while _scratch:
        remove(spark, _scratch.pop())


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that nothing refers to any more: it does so when the JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder: for wide rows, which a checkpoint would hold uncompressed."""
    spark = df.sparkSession
    where = scratch(spark, "stored")
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name like `name` that none of the tables has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Positions of a bitmap over hashed keys: at most 2048 rows of 4 KB, so 8 MB, however many keys.
POSITIONS = 2**26


def bitmap(keys: DataFrame) -> DataFrame:
    """(bucket, bits): the hashed values of the one column of `keys`, as a table of at most 2048 rows."""
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(POSITIONS)) + 1
    return keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def sifted(df: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose key may be in the bitmap, and rows whose key is null or surely isn't.

    The bitmap has a fixed size and is broadcast, so neither part is shuffled. A key that is none of
    the bitmap's gets into the first part with a probability of about (keys in it) / 2**26.
    """
    bucket, held = fresh("_bucket", df), fresh("_bits", df)
    at = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(POSITIONS)) + 1
    place = F.bitmap_bit_position(at)
    # byte `place / 8` of the bits, lowest bit first
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    small = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held)))
    joined = df.join(small, F.bitmap_bucket_number(at) == F.col(bucket), "left")
    return tuple(joined.filter(c).select(*[F.col(f"`{n}`") for n in df.columns]) for c in (on, ~on))


def looked_up(df: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """df left-joined with table, which has one row a key, n rows of df each, of `total`.

    Rows without a key in the table mostly stay where they are, by a bitmap of its keys. Keys with more than
    a thousandth of the rows, at most a thousand of them, are broadcast; so no key of the shuffle is hot.
    """
    rest = [c for c in table.columns if c not in (key, n)]
    found = fresh("_found", df)
    maybe, clear = sifted(df, key, bitmap(table.select(key)))
    hot = F.broadcast(table.filter(F.col(n) * 1000 > total).select(key, F.struct(*rest).alias(found)))
    met = maybe.join(hot, key, "left")
    at_hot = met.filter(F.col(found).isNotNull()).select(*df.columns, *[F.col(f"{found}.{c}").alias(c) for c in rest])
    others = met.filter(F.col(found).isNull()).select(*df.columns).join(table.filter(F.col(n) * 1000 <= total).select(key, *rest), key, "left").select(*df.columns, *rest)
    types = dict(table.dtypes)
    return at_hot.unionByName(others).unionByName(clear.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in rest]))


def fold_ascii(c):
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sorted_groups(batches, n_keys: int):
    """(key values, table) of each run of rows with equal values in the first n_keys columns, over Arrow batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.array(b.column(k).to_pylist()) for k in range(n_keys)]
        changed = np.zeros(b.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            here = tuple(c[start] for c in columns)
            if key is not None and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(b.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)
