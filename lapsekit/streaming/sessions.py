"""Sessions by inactivity gap (S2), batch and streaming.

Batch form (``sessionize``): Spark's ``session_window`` sorts all events of a user in one task,
so a user holding a third of the events would be one straggler. Instead:

* time is cut into buckets (one gap wide by default, narrower on request), and windows run per
  (user, bucket); a heavy user is spread over as many tasks as it has buckets;
* an event opens a session when the previous event of the user is more than one gap earlier.
  The previous event is found inside the bucket, or as the latest event of all earlier buckets
  (a running max over a small per-bucket table);
* an event's session start is the latest opening event at or before it: inside the bucket
  by a running max, else carried from earlier buckets by a running max over the per-bucket
  table (one row per user and bucket).

Consecutive events belong to one session iff they are at most ``gap`` apart, the same rule as
``session_window`` (its windows ``[t, t + gap)`` merge when the next one starts at or before the
previous end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP or TIMESTAMP_NTZ, independent of the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def gap_micros(gap: str) -> int:
    """'8 hours' / '30 minutes' / '45 seconds' / '2 days' -> microseconds."""
    n, unit = gap.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(n) * mult * 1_000_000)


def sessionize(ev: DataFrame, gap: str = "8 hours", user: str = "customer_id", ts: str = "event_ts",
               tie: str = "event_id", bucket: str | None = None) -> DataFrame:
    """Add ``session_start`` (timestamp of the opening event) and ``session_id`` to every event.

    ``bucket`` (default: the gap) is the unit of work per user; a smaller bucket splits a user
    whose events crowd into one gap-long stretch. The previous event of a bucket's first row is
    the latest event of all earlier buckets, read from the per-(user, bucket) table.
    """
    g = gap_micros(gap)
    bw = gap_micros(bucket) if bucket else g
    e = ev.withColumn("_us", epoch_micros(ts)).withColumn("_b", F.floor(F.col("_us") / F.lit(bw)).cast("long"))
    w = Window.partitionBy(user, "_b").orderBy("_us", tie)
    earlier = Window.partitionBy(user).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    # latest event time of all earlier buckets (per-bucket table: one row per user and bucket)
    per_bucket = e.groupBy(user, "_b").agg(F.max("_us").alias("_bmax"))
    prev_max = per_bucket.select(user, "_b", F.max("_bmax").over(earlier).alias("_prev_max"))
    e = e.join(prev_max, on=[user, "_b"], how="left")
    prev = F.coalesce(F.lag("_us").over(w), F.col("_prev_max"))
    e = e.withColumn("_opens", prev.isNull() | ((F.col("_us") - prev) > F.lit(g)))
    e = e.withColumn("_start_in", F.max(F.when(F.col("_opens"), F.col(ts))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))

    # session start carried into a bucket from earlier buckets
    starts = e.groupBy(user, "_b").agg(F.max(F.when(F.col("_opens"), F.col(ts))).alias("_last_start"))
    carried = starts.select(user, "_b", F.max("_last_start").over(earlier).alias("_carried"))
    e = e.join(carried, on=[user, "_b"], how="left")
    e = e.withColumn("session_start", F.coalesce(F.col("_start_in"), F.col("_carried")))
    return (e.withColumn("session_id", F.concat_ws("-", F.col(user).cast("string"),
                                                   epoch_micros("session_start").cast("string")))
            .drop("_us", "_b", "_prev_max", "_opens", "_start_in", "_carried"))


def session_summary(sessions: DataFrame, kinds: Sequence[str], booking_kind: str, user: str = "customer_id",
                    ts: str = "event_ts", kind: str = "event_name") -> DataFrame:
    """One row per session: start, end, event count, count per kind, converted flag."""
    aggs = [F.min(ts).alias("session_start_ts"), F.max(ts).alias("session_end"),
            F.count(F.lit(1)).alias("n_events")]
    aggs += [F.count_if(F.col(kind) == F.lit(k)).alias(k) for k in kinds]
    out = sessions.groupBy("session_id", user).agg(*aggs)
    return (out.withColumn("converted", F.col(booking_kind) > 0)
            .withColumnRenamed("session_start_ts", "session_start"))


def stream_sessions(ev: DataFrame, gap: str, delay: str, kinds: Sequence[str], booking_kind: str,
                    user: str = "customer_id", ts: str = "event_ts", kind: str = "event_name") -> DataFrame:
    """Streaming form: ``session_window`` with a watermark; state per user is bounded by gap + delay.
    Emits closed sessions in append mode."""
    t = F.col(ts).cast("timestamp")
    aggs = [F.count(F.lit(1)).alias("n_events")] + [F.count_if(F.col(kind) == F.lit(k)).alias(k) for k in kinds]
    out = (ev.withColumn("_t", t).withWatermark("_t", delay)
           .groupBy(user, F.session_window("_t", gap).alias("session")).agg(*aggs))
    return out.select(user, F.col("session.start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session.end").cast("timestamp_ntz").alias("session_window_end"),
                      "n_events", *kinds, (F.col(booking_kind) > 0).alias("converted"))
