"""Streaming extensions, run to the end over the files of events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epochlake.sources import stores
from epochlake.streaming import windows

from .common import Queries, read

Q = Queries()


def _finished(spark, sf_dir, build, mode: str, rest=None):
    """What a stream over events has put out once all files are read: its last table in complete mode, else all it added.

    rest: what a closing batch adds to that from the stream's state, of whose folder it is a function.
    """
    schema = read(spark, sf_dir, "events").schema
    out = build(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    where = f"{stores.folder(spark)}/stream-{uuid.uuid4().hex}"
    paths = {}

    def put(batch, k):
        batch.write.mode("overwrite").parquet(f"{where}/out-{k}")
        paths[k] = f"{where}/out-{k}"

    query = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not paths:
        return spark.createDataFrame([], out.schema)
    done = spark.read.schema(out.schema).parquet(*([paths[max(paths)]] if mode == "complete" else paths.values()))
    return done.unionByName(rest(f"{where}/state")) if rest else done


@Q.add("stream_tumbling", """SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""", digits=6)
def stream_tumbling(spark, sf_dir):
    out = _finished(spark, sf_dir, lambda s: windows.time_windows(s, ["event_type"], "value", "1 day"), "complete")
    return out.select("event_type", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(start AS timestamp_ntz))").alias("start"), "n", "total")


@Q.add("stream_counted_epochs", "SELECT user_id, pos // 8 AS epoch, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) GROUP BY user_id, pos // 8 HAVING count(*) = 8")
def stream_counted_epochs(spark, sf_dir):
    return _finished(spark, sf_dir, lambda s: windows.counted_epochs(s, "user_id", "value", 8), "append")


_GAPS = "g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)"


@Q.add("stream_sessions", f"WITH {_GAPS} SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS end, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    """All sessions: each comes out once the watermark has passed its end and leaves the state; a closing batch adds those still open at the end of the run. Times in microseconds."""
    out = _finished(spark, sf_dir, lambda s: windows.sessions(s, ["user_id"], "30 minutes"), "append", lambda state: windows.open_sessions(spark, state, ["user_id"]))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
