"""Event counts per kind and time window, batch and streaming.

The same function serves both: on a batch DataFrame it windows the naive timestamps directly
(independent of the session time zone); on a streaming DataFrame the timestamp is cast to
``TIMESTAMP`` (``withWatermark`` rejects ``TIMESTAMP_NTZ``), a watermark bounds the state, and
windows are emitted once closed (append mode). Rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_window_counts(ev: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day",
                        ts: str = "event_ts", kind: str = "event_name") -> DataFrame:
    """Events per (window, kind); tumbling when ``slide`` is None, sliding otherwise."""
    t = F.col(ts)
    if ev.isStreaming:
        ev = ev.withColumn("_t", t.cast("timestamp")).withWatermark("_t", delay)
        t = F.col("_t")
    w = F.window(t, window, slide) if slide else F.window(t, window)
    out = ev.groupBy(w.alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), kind, "n_events")


EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream, renamed to the click-stream model."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path)
    return s.select("event_id", F.col("user_id").alias("customer_id"), F.col("event_type").alias("event_name"),
                    F.col("ts").alias("event_ts"), "value", "props")


def start_counts(spark: SparkSession, src: str, sink: str, checkpoint: str, window: str = "1 day",
                 delay: str = "1 day"):
    """Run S1 from a folder of parquet files into parquet, append mode, with a checkpoint folder
    (put it under the shared ``spark.checkpoint.dir`` on a cluster)."""
    counts = event_window_counts(read_event_stream(spark, src), window, None, delay)
    return (counts.writeStream.outputMode("append").format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).start())
