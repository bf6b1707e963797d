"""Sessions by inactivity gap as a stateful stream, with the batch form's session ids.

``session_window`` merges windows but keeps only aggregates and cannot name a session as ``sessions.sessionize`` does. Here every user
has the list of its open sessions as state (start, end, counts). New events and open sessions are merged as intervals: sorted by start, an interval
opens a session if it begins more than the gap after all ends before it, which is the batch rule whatever the order of arrival.
A session is closed, put out and dropped from the state once the watermark has passed its end by the gap, as no event that is still taken can reach it.
One event-time timer per user, at the earliest such moment, closes sessions of users without new events.

State of a user is bounded by its sessions inside gap + delay. Events behind the watermark are dropped before they reach the state; Spark counts
them (``late_rows``). State and progress live under the query's checkpoint folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapsekit.streaming.sessions import epoch_micros, gap_micros


def merge_intervals(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals at most ``gap`` apart become one; ``counts`` (a row per interval) add up. Sorted by start."""
    if not len(starts):
        return starts, ends, counts
    order = np.argsort(starts, kind="stable")
    starts, ends, counts = starts[order], np.maximum.accumulate(ends[order]), counts[order]
    first = np.flatnonzero(np.concatenate(([True], starts[1:] - ends[:-1] > gap)))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return starts[first], ends[last], np.add.reduceat(counts, first, axis=0)


def stateful_sessions(ev: DataFrame, gap: str, delay: str, kinds: Sequence[str], booking_kind: str, user: str = "customer_id",
                      ts: str = "event_ts", kind: str = "event_name") -> DataFrame:
    """Closed sessions of a stream of events, in the columns of ``sessions.session_summary`` (append mode).

    Events without a user or a time are left out; kinds outside ``kinds`` count in ``n_events`` alone, as in the batch form.
    """
    g, kinds = gap_micros(gap), list(kinds)
    width = len(kinds) + 1
    index = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)), F.lit(0)).cast("int")    # 0: none of them
    rows = ev.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(user), F.col(ts).cast("timestamp").alias("_t"), epoch_micros(ts).alias("_us"), index.alias("_kind")).withWatermark("_t", delay)
    user_type = ev.schema[user].dataType.simpleString()
    put = f"{user} {user_type}, start long, end long, counts array<long>"
    kept = "starts array<long>, ends array<long>, counts array<array<long>>"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, counts = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64))
        if state.exists:
            s, e, c = state.get
            starts, ends, counts = np.array(s, np.int64), np.array(e, np.int64), np.array(c, np.int64).reshape(-1, width)
        if not state.hasTimedOut:
            for chunk in chunks:                                    # merged chunk by chunk: a crowded user needs no list of its events
                us, k = chunk["_us"].to_numpy(np.int64), chunk["_kind"].to_numpy(np.int64)
                one = np.zeros((len(us), width), np.int64)
                one[:, 0] = 1
                one[np.flatnonzero(k > 0), k[k > 0]] = 1
                starts, ends, counts = merge_intervals(np.concatenate((starts, us)), np.concatenate((ends, us)), np.concatenate((counts, one)), g)
        until = -(-(ends + g) // 1000)                              # the first millisecond at which no taken event reaches the session
        closed = until <= state.getCurrentWatermarkMs()
        if closed.all():
            if state.exists:
                state.remove()
        else:
            o = ~closed
            state.update((starts[o].tolist(), ends[o].tolist(), counts[o].tolist()))
            state.setTimeoutTimestamp(int(until[o].min()))
        if closed.any():
            yield pd.DataFrame({user: [key[0]] * int(closed.sum()), "start": starts[closed], "end": ends[closed], "counts": counts[closed].tolist()})

    out = rows.groupBy(user).applyInPandasWithState(step, put, kept, "append", GroupStateTimeout.EventTimeTimeout)
    when = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return out.select(
        F.concat_ws("-", F.col(user).cast("string"), F.col("start").cast("string")).alias("session_id"), user,
        when("start").alias("session_start"), when("end").alias("session_end"), F.col("counts")[0].alias("n_events"),
        *[F.col("counts")[i + 1].alias(k) for i, k in enumerate(kinds)], (F.col("counts")[kinds.index(booking_kind) + 1] > 0).alias("converted"))


def start_sessions(spark, src: str, sink: str, checkpoint: str, gap: str, delay: str, kinds: Sequence[str], booking_kind: str, max_files: int | None = None):
    """Run S2 from a folder of Parquet files into Parquet; ``checkpoint`` belongs under the shared folder on a cluster."""
    from lapsekit.streaming.events import read_event_stream
    out = stateful_sessions(read_event_stream(spark, src, max_files), gap, delay, kinds, booking_kind)
    return out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()


def late_rows(query) -> int:
    """Events behind the watermark that the query has dropped, over the progress reports that Spark keeps."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
