"""The driver tables in their roles, and how a query is registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.operators import epochs

EPOCH = 8
SPARSE = 8

#: recordings: a user's events in time order
R = "r AS (SELECT user_id AS subject, (user_id % 2)::INT AS label, event_type AS channel, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
#: tumbling epochs of 8 events
EP = "ep AS (SELECT subject, any_value(label) AS label, pos // 8 AS epoch, list(value ORDER BY pos) AS x FROM r GROUP BY subject, pos // 8 HAVING count(*) = 8)"
#: four channels of 16 samples from each embedding
CH = """ch AS (SELECT vec_id, label * 5 + vec_id % 5 AS subject, (label % 2)::INT AS y, ['Fz', 'Cz', 'Pz', 'Oz'][k + 1] AS channel, embedding[k * 16 + 1 : k * 16 + 16]::DOUBLE[] AS x
  FROM embeddings, range(0, 4) t(k))"""
CHANNELS = ["Fz", "Cz", "Pz", "Oz"]


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), (F.col("user_id") % 2).cast("int").alias("label"), F.col("event_type").alias("channel"), "ts", "event_id", "value")


def event_epochs(spark, sf_dir: str) -> DataFrame:
    """(subject, label, epoch, x)"""
    return epochs.tumbling(recordings(spark, sf_dir), ["subject", "label"], ["ts", "event_id"], "value", EPOCH)


def channel_epochs(spark, sf_dir: str) -> DataFrame:
    """(vec_id, subject, y, channel, x): the multichannel epoch store."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") * 5 + F.col("vec_id") % 5).alias("subject"), (F.col("label") % 2).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    return epochs.channels(e, ["vec_id", "subject", "y"], "x", CHANNELS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


class Queries:
    """Named queries with their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None, digits: int = 6):
        def register(f):
            self.queries[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
            if sql:
                self.sql[name] = sql
            return f

        return register

    def also(self, name: str, of: str) -> None:
        """A second name of a query."""
        self.queries[name] = self.queries[of]
        if of in self.sql:
            self.sql[name] = self.sql[of]
